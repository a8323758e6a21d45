"""Hand-checkable cases of the library's own operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom import registry
from rankloom.functions import scalars as S
from rankloom.operators import clustering, curation, evaluation, kmers, mining, neighbours, ordering, taxonomy
from rankloom.plans import adapters, shared
from rankloom.sources import fasta


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_header(spark):
    h = F.lit("{71_V4}MAG_0042.3~ctg7 d__Archaea;p__Halo [location=5..77]")
    r = one(spark, g=S.genome_id(h), i=S.header_index(h), r=S.header_region(h), t=S.padded_path(S.taxonomy_path(h)))
    assert (r["g"], r["i"], r["r"]) == ("MAG_0042.3", 71, "V4")
    assert r["t"] == ["Archaea", "Halo", "", "", "", "", ""]


def test_kmers(spark):
    rows = spark.createDataFrame([(1, "GGATTCAG"), (2, "ATNCG"), (3, "AC")], "id long, s string")
    got = {(r["id"], r["kmer"]): r["n"] for r in kmers.kmer_counts(rows, "id", "s", 4).collect()}
    assert got == {(1, k): 1 for k in ("GGAT", "GATT", "ATTC", "TTCA", "TCAG")}
    assert [one(spark, x=S.kmer_index(F.lit(k)))["x"] for k in ("AAAA", "AAAC", "AAAT", "AACA")] == [0, 1, 3, 4]


def test_codes(spark):
    r = one(spark, c=S.fitted(S.base_codes(F.lit("ACGTN")), 7), t=S.trimmed(F.lit("AACCGG"), 2), e=S.trimmed(F.lit("AACC"), 2), rc=S.reverse_complement(F.lit("AACG")))
    assert (r["c"], r["t"], r["e"], r["rc"]) == ([0, 1, 2, 3, 4, 4, 4], "CC", "", "CGTT")


@given(st.lists(st.floats(0, 50), min_size=1, max_size=9), st.integers(0, 500), st.floats(0, 0.2), st.floats(0.3, 1))
@settings(max_examples=10_000, deadline=None)
def test_budgets_sum_up_and_keep_their_limits(hardness, total, least, most):
    got = mining.budgets(hardness, total, least, most)
    live = [k for k, h in enumerate(hardness) if h > 0]
    assert all(got[k] == 0 for k in range(len(got)) if k not in live) and sum(got) == (total if live else 0)
    if live and least * len(live) <= 1:
        hardest = max(live, key=lambda k: (hardness[k], -k))
        assert all(int(least * total) - 1 <= got[k] for k in live)
        assert all(got[k] <= most * total + 1 for k in live if k != hardest)


def test_budgets():
    assert sum(mining.budgets([1.0, 1.0, 1.0], 10, 0, 1)) == 10
    assert mining.budgets([0, 0], 5) == [0, 0]
    assert mining.budgets([51.0, 47.0, 2.0], 100, 0.05, 0.5) == [50, 45, 5]
    assert sum(mining.budgets([0.25, 0.25, 5e-324, 5e-324], 16, 0.0, 0.3125)) == 16
    assert sum(mining.budgets([1e-200, 1e-200], 7, exponent=2.0)) == 7
    # With all others at the least, the hardest takes what is left, over its most.
    assert mining.budgets([100.0, 1.0, 1.0], 100, 0.05, 0.5) == [90, 5, 5]


def test_bucket_ties_go_up(spark):
    assert one(spark, b=mining.bucket_of(F.lit(0.5), F.array(F.lit(0.5), F.lit(0.9))))["b"] == 1


def test_bucket_sample_borrows_the_hardest(spark):
    rows = spark.createDataFrame([(k, 0, 0, k / 10) for k in range(8)] + [(8, 0, 1, 9.0)], "id long, rank int, bucket int, err double")
    got = mining.bucket_sample(rows, {0: [2, 3, 1]}, F.col("id")).collect()
    assert len(got) == 6 and {8, 7, 6} <= {r["id"] for r in got}


def test_shared_rank_counts_match_pairs(spark):
    rows = spark.createDataFrame([(k, f"a{k % 2}", f"b{k % 4}", f"c{k % 3}") for k in range(30)], "id long, r0 string, r1 string, r2 string")
    fast = {r["shared_rank"]: r["n_pairs"] for r in taxonomy.shared_rank_counts(rows, ["r0", "r1", "r2"]).collect()}
    d = [tuple(r)[1:] for r in rows.collect()]
    slow = {k: 0 for k in range(-1, 3)}
    for i in range(30):
        for j in range(i + 1, 30):
            depth = -1
            while depth < 2 and d[i][depth + 1] == d[j][depth + 1]:
                depth += 1
            slow[depth] += 1
    assert fast == slow


def test_nearest_and_hierarchy(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0], "x", "p"), (2, [0.9, 0.1], "x", "q"), (3, [0.0, 1.0], "y", "r")], "b long, bv array<double>, r0 string, r1 string")
    q = spark.createDataFrame([(10, [1.0, 0.05])], "q long, qv array<double>")
    assert neighbours.nearest(q, base.select("b", "bv")).first()["b"] == 1
    r = neighbours.hierarchical(q, base, ["r0", "r1"], [2, 2]).first()
    assert (r["p_r0"], r["p_r1"]) == ("x", "p") and r["c_r1"] <= r["c_r0"] <= 1


def test_scores(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 1)], "l string, k long")
    r = evaluation.agreement(rows, "l", "k").first()
    assert (r["v_measure"], r["adjusted_rand"]) == (1.0, 1.0)
    assert evaluation.adjusted_mutual_information(rows, "l", "k").first()["ami"] == 1.0
    d = one(spark, n=evaluation.deepest_correct(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("x"), F.lit("c"))))
    assert d["n"] == 1


def test_funnel_and_first(spark):
    rows = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b")], "ord long, s string")
    assert sorted(r["ord"] for r in curation.first_of_each(rows, "s", "ord").collect()) == [1, 3]
    f = curation.funnel(rows, [("short", F.length("s") > 1), ("never", F.lit(True))]).orderBy("step").collect()
    assert [(r["removed"], r["remaining"]) for r in f] == [(1, 2), (0, 2)]


def test_fasta_round_trip(spark, tmp_path):
    p = tmp_path / "V4_seqs.fasta"
    p.write_text(">a one\nACGT\nAC\n>b two\nGG\n")
    got = fasta.read_regions(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["header"], r["seq"], r["region_id"]) for r in got] == [("a one", "ACGTAC", "V4"), ("b two", "GG", "V4")]
    fasta.write_fasta(fasta.read_fasta(spark, str(p)), str(tmp_path / "out"))
    assert sorted(r["seq"] for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()) == ["ACGTAC", "GG"]


def test_entry_and_every_oracle_has_a_query(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_neighbours_among_all_vectors(spark):
    from rankloom import registry
    from rankloom.plans import adapters

    d = "/root/testdata/sf0.01"
    vecs = {r["vec_id"]: r["v"] for r in adapters.vecs(spark, d).select("vec_id", "v").collect()}
    want = set()
    for q in (k for k in vecs if k % 100 == 0):
        near = sorted((round(1 - sum(x * y for x, y in zip(vecs[q], v, strict=True)), 9), b) for b, v in vecs.items() if b != q)[:5]
        want |= {(q, b, k + 1) for k, (_, b) in enumerate(near)}
    got = {(r["q"], r["b"], r["place"]) for r in registry.QUERIES["J13_W8_neighbours"](spark, d).collect()}
    assert got == want and any(b % 5 == 0 for _, b, _ in got)


# Twins in numpy of what SQL can't express


def points(spark, n=120, k=4, dims=6):
    draw = np.random.default_rng(3)
    label = draw.integers(0, k, n)
    x = draw.normal(size=(k, dims))[label] + draw.normal(scale=0.7, size=(n, dims))
    return x, label, spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(n)], "id long, v array<double>, label long")


@pytest.mark.parametrize("spherical", [True, False])
def test_kmeans_against_numpy(spark, monkeypatch, spherical):
    x, label, rows = points(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True) if spherical else x
    c = np.stack([unit[label == k].mean(0) for k in range(4)])
    c = c / np.linalg.norm(c, axis=1, keepdims=True) if spherical else c
    assign = lambda c: (unit @ c.T).argmax(1) if spherical else ((unit[:, None] - c) ** 2).sum(2).argmin(1)
    for _ in range(200):
        at = assign(c)
        new = np.stack([unit[at == k].mean(0) if (at == k).any() else c[k] for k in range(4)])
        new = new / np.linalg.norm(new, axis=1, keepdims=True) if spherical else new
        shift, c = np.linalg.norm(new - c, axis=1).mean(), new
        if shift <= 5e-4:
            break
    got = {r["id"]: r["cluster"] for r in clustering.kmeans(rows, "id", "v", "label", spherical).collect()}
    assert got == dict(enumerate(assign(c).tolist()))
    assert clustering.kmeans(rows.limit(0), "id", "v", "label").count() == 0
    monkeypatch.setattr(clustering, "BLOCK", 100)  # the same where the centres are a table, two to a block
    assert {r["id"]: r["cluster"] for r in clustering.kmeans(rows, "id", "v", "label", spherical).collect()} == got


def test_clusters_of_all_scored_on_a_part(spark):
    x, label, rows = points(spark)
    clusters = clustering.kmeans(rows, "id", "v", "label")
    part = {r["id"]: r["cluster"] for r in clusters.collect() if r["id"] % 3 == 0}
    want = evaluation.agreement(spark.createDataFrame([(int(label[i]), k) for i, k in part.items()], "l long, k long"), "l", "k").first()
    assert clustering.scored_subset(clusters, rows, "id", "label", F.col("id") % 3 == 0).first() == want
    got = clustering.evaluated(rows, "id", "v", ["label"], {"third": F.col("id") % 3 == 0, "one": F.col("label") == 0}).collect()
    assert [(r["spherical"], r["case"], r["n_rows"]) for r in got] == [(True, "third", 40), (False, "third", 40)] and got[0]["v_measure"] == want["v_measure"]


def test_projection_against_numpy(spark):
    x, _, rows = points(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centred = unit - unit.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    want = centred @ axes[:2].T
    got = np.array([[r["x0"], r["x1"]] for r in clustering.projection(rows, "id", "v").orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_adjusted_mutual_information_against_permutations(spark):
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 4, 200), draw.integers(0, 3, 200)
    b[:80] = a[:80] % 3

    def information(x, y):
        table = np.zeros((4, 3))
        np.add.at(table, (x, y), 1)
        p = table / table.sum()
        q = p.sum(1, keepdims=True) @ p.sum(0, keepdims=True)
        return (p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum()

    entropy = lambda x: -sum(p * math.log(p) for p in np.bincount(x)[np.bincount(x) > 0] / len(x))
    expected = np.mean([information(a, draw.permutation(b)) for _ in range(4000)])
    want = (information(a, b) - expected) / ((entropy(a) + entropy(b)) / 2 - expected)
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "l long, k long")
    assert abs(evaluation.adjusted_mutual_information(rows, "l", "k").first()["ami"] - want) < 0.005


def test_p_values(spark):
    # Student's t with 2 degrees of freedom has a closed form: P(|t| > x) = 1 - x / sqrt(x^2 + 2).
    for r in (0.1, 0.5, 0.9, -0.7):
        t = abs(r) * math.sqrt(2 / (1 - r * r))
        assert abs(evaluation._t_tail(r, 4) - (1 - t / math.sqrt(t * t + 2))) < 1e-9
    assert abs(evaluation._t_tail(0.2, 102) - 0.04389) < 1e-4 and evaluation._t_tail(1.0, 10) == 0.0 and evaluation._t_tail(0.5, 2) is None
    got = evaluation.with_p_values(spark.createDataFrame([(0.5, 4), (None, 9)], "r double, n long"), "r", "n", "p").collect()
    assert got[0]["p"] == 0.5 and got[1]["p"] is None


def test_places_and_quantiles_over_partitions(spark):
    draw = np.random.default_rng(7)
    rows = [(int(k), "a" if draw.random() < 0.7 else None, float(draw.normal()) if draw.random() < 0.9 else None) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(7)
    got = {r["g"]: (r["n_rows"], r["q"]) for r in ordering.quantiles(df, ["g"], "x", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    for g in ("a", None):
        x = [r[2] for r in rows if r[1] == g and r[2] is not None]
        assert got[g][0] == len(x) and np.allclose(got[g][1], np.percentile(x, [0, 10, 50, 99, 100]))
    placed = ordering.numbered(df, ["g"], ["id"], "place", "size").collect()
    for g in ("a", None):
        ids = [r[0] for r in rows if r[1] == g]
        assert {r["id"]: (r["place"], r["size"]) for r in placed if r["g"] == g} == {i: (k, len(ids)) for k, i in enumerate(ids)}
    filled = {r["id"]: r["x"] for r in ordering.carried_on(df, ["g"], ["id"], "x").collect()}
    for g in ("a", None):
        last = None
        for i, h, x in rows:
            if h == g:
                last = x if x is not None else last
                assert filled[i] == last
    assert ordering.quantiles(df.limit(0), [], "x", [0.5]).count() == 0


def test_mined_triplets_keep_the_rules(spark):
    x, label, rows = points(spark, 60)
    rows = rows.withColumn("top", F.col("label") % 2)
    pairs = mining.labelled_pairs(rows, "id", ["top", "label"], "v", {0: 0.8, 1: 0.3}, 1.6, F.lit(True))
    assert pairs.count() == 60 * 59 // 2
    got, state = mining.mine_triplets(pairs, [0, 1], 500, 200)
    got = got.collect()
    shared = lambda i, j: -1 if label[i] % 2 != label[j] % 2 else 1 if label[i] == label[j] else 0
    assert 0 < len(got) <= 200
    for r in got:
        assert shared(r["anchor"], r["positive"]) >= r["rank"] and shared(r["anchor"], r["negative"]) == r["rank"] - 1
        assert abs(r["violation"] - max(0.0, r["ap"] - r["an"] + r["margin"])) < 1e-6
    assert {r["rank"] for r in state.collect()} == {0, 1}
    hard, after = mining.mine_pairs(pairs, 400, 150)
    hard = hard.collect()
    assert len(hard) == 150 and len({(r["i"], r["j"]) for r in hard}) == 150 and {r["rank"] for r in after.collect()} == {-1, 0, 1}
    none = mining.mine_pairs(pairs.limit(0), 10, 10)[0]
    assert none.count() == 0 and mining.mine_triplets(pairs.limit(0), [0], 10, 10)[0].count() == 0


def test_bucket_sample_takes_what_a_plain_reading_takes(spark):
    draw = np.random.default_rng(9)
    rows = [(int(k), int(k % 2), int(min(3, draw.geometric(0.5) - 1)), float(draw.random())) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, rank int, bucket int, err double")
    wanted = {0: [10, 20, 30, 40, 5], 1: [60, 5, 60, 2, 0]}
    got = {r["id"] for r in mining.bucket_sample(df, wanted, F.col("id")).collect()}
    chance = lambda i, seed: ((i % 2147483648) * 1103515245 + 12345 + seed) % 2147483648
    want = set()
    for rank, target in wanted.items():
        left = {b: {r[0]: r[3] for r in rows if r[1] == rank and r[2] == b} for b in range(4)}
        took, anyhow, plan = set(), target[4], []
        for b in range(3, -1, -1):
            plan.append((b, min(target[b], len(left[b]))))
            short = target[b] - plan[-1][1]
            mine = sorted(left[b], key=lambda i: (chance(i, 0), i))[: plan[-1][1]]
            took |= set(mine)
            for i in mine:
                del left[b][i]
            for easier in range(b - 1, -1, -1):
                lent = sorted(left[easier], key=lambda i: (-left[easier][i], i))[:short]
                took |= set(lent)
                short -= len(lent)
                for i in lent:
                    del left[easier][i]
            anyhow += short
        rest = sorted((i for b in left.values() for i in b), key=lambda i: (chance(i, 1), i))[:anyhow]
        want |= took | set(rest)
    assert got == want


def test_scans_that_check_what_they_read(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">{1}A~x d__B\nAC\n>{3}C~x d__B\nGT\n")
    with pytest.raises(Exception, match="index out of order"):
        fasta.consecutive(fasta.read_headers(spark, str(tmp_path / "a.fasta"))).collect()
    (tmp_path / "parts").mkdir()
    for name, n in (("part-0", (1, 2)), ("part-1", (3,))):
        (tmp_path / "parts" / name).write_text("".join(f">{{{k}}}A~x d__B\nAC\n" for k in n))
    assert [r["idx"] for r in fasta.consecutive(fasta.read_headers(spark, str(tmp_path / "parts")), folder=True).orderBy("idx").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="index out of order"):
        fasta.consecutive(fasta.read_headers(spark, str(tmp_path / "parts"))).collect()
    dropped = fasta.validated(fasta.read_fasta(spark, str(tmp_path / "parts")), least=3, drop=True)
    assert dropped.count() == 0
    with pytest.raises(Exception, match="invalid sequence"):
        fasta.validated(fasta.read_fasta(spark, str(tmp_path / "a.fasta")), least=40).collect()
    (tmp_path / "map.json").write_text('{"region_indices": {"0": "FULL", "1": "V4", "2": "V4"}}')
    with pytest.raises(Exception, match="region id used twice"):
        fasta.read_region_map(spark, str(tmp_path / "map.json")).collect()
    leaves = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(Exception, match="no leaf: 2, 3"):
        curation.required_leaves(spark.createDataFrame([(1,), (3,), (2,)], "k long"), leaves, "k").collect()
    with pytest.raises(ValueError, match="k must be"):
        kmers.kmer_counts(spark.createDataFrame([(1, "AC")], "id long, s string"), "id", "s", 32)


def test_a_batch_from_the_rows(spark):
    x, label, rows = points(spark, 80)
    rows = rows.select((F.col("id") * 7 + 3).alias("key"), (F.col("label") % 2).alias("top"), "label", "v")
    hard, triples, states = mining.mine_batch(rows, "key", ["top", "label"], "v", 3, F.lit(True), {0: 0.8, 1: 0.3}, 1.6, share=0.5, copies=0.3, other_view=F.reverse, totals=(120, 60))
    hard, triples = hard.collect(), triples.collect()
    keys = {k * 7 + 3 for k in range(80)}
    assert {r["i"] for r in hard} | {r["j"] for r in hard} <= keys and all((r["i"] == r["j"]) == (r["rank"] == 7) for r in hard) and any(r["rank"] == 7 for r in hard)
    assert 0 < len(hard) <= 120 and sorted(r["position"] for r in hard) == list(range(len(hard))) and {r["batch"] for r in hard} == {3}
    assert triples and all(label[(r["anchor"] - 3) // 7] % 2 == label[(r["positive"] - 3) // 7] % 2 or r["rank"] < 0 for r in triples)
    assert {r["rank"] for r in states[0].collect()} == {r["rank"] for r in hard}


def test_all_taxa_of_a_size_are_excluded(spark, sf):
    got = registry.QUERIES["F14_excluded_taxa"](spark, sf).collect()
    sizes = {r["r1"]: r["count"] for r in adapters.tax4(spark, sf).groupBy("r1").count().collect() if 3 <= r["count"] <= 100_000}
    assert {r["r1"]: r["n_rows"] for r in got} == sizes and len(sizes) > 7
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",)], "r string")
    assert curation.excluded_taxa(rows, "r", 2, 2, 1).count() == 1
    with pytest.raises(Exception, match="fewer than 3"):
        curation.excluded_taxa(rows, "r", 2, 2, 3).collect()


def test_shared_ranks_spread_a_large_taxon_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(shared, "PAIRS", 64)
    monkeypatch.setattr(shared, "QUERIES", 3)
    rows = spark.createDataFrame([(k, None if k == 7 else "a", f"b{k % 3}") for k in range(60)], "id long, r0 string, r1 string")
    got = taxonomy.shared_ranks(rows.where("id % 10 = 0 OR id = 7"), rows, "id", ["r0", "r1"])
    assert got.rdd.getNumPartitions() > 2
    asked = range(0, 60, 10)
    assert {(r["i"], r["j"]): r["shared_rank"] for r in got.collect()} == {(i, j): int(i % 3 == j % 3) for i in asked for j in range(60) if i != j and j != 7}


def test_labelled_pairs_in_blocks_against_plain_reading(spark, monkeypatch):
    monkeypatch.setattr(shared, "PAIRS", 64)
    monkeypatch.setattr(shared, "QUERIES", 3)
    monkeypatch.setattr(mining, "CELLS", 8)
    draw = np.random.default_rng(5)
    v = draw.normal(size=(40, 6)).round(3)
    data = [(k, ["a", "b", None][k % 3], f"c{k % 2}", None if k in (4, 11) else v[k].tolist()) for k in range(40)]
    rows = spark.createDataFrame(data, "id long, r0 string, r1 string, v array<double>")
    got = mining.labelled_pairs(rows, "id", ["r0", "r1"], "v", {0: 0.8, 1: 0.3}, 1.6, F.col("id") % 4 == 0)
    assert got.rdd.getNumPartitions() > 4
    want = {}
    for i in range(0, 40, 4):
        for j in range(40):
            if i != j and (j % 4 or i < j):
                a, b = data[i], data[j]
                rank = -1 if a[1] is None or a[1] != b[1] else 0 if a[2] != b[2] else 1
                want[i, j] = (rank, {-1: 1.6, 0: 0.8, 1: 0.3}[rank], None if a[3] is None or b[3] is None else pytest.approx(1 - v[i] @ v[j], abs=2e-9))
    assert {(r["i"], r["j"]): (r["rank"], r["true"], r["pred"]) for r in got.collect()} == want


def test_products_with_many_queries_take_few_rows(spark, monkeypatch):
    assert 50_000 * neighbours.step(50_000) <= neighbours.CELLS and neighbours.step(1) == neighbours.ROWS and neighbours.step(1 << 40) == 1
    v = np.random.default_rng(9).normal(size=(50, 4))
    rows = spark.createDataFrame([(k, x.tolist(), ["a" if k % 2 else "b"]) for k, x in enumerate(v)], "b long, bv array<double>, path array<string>")
    asked = rows.where("b % 5 = 0").select(F.col("b").alias("q"), F.col("bv").alias("qv"), "path")
    sizes = []
    step = neighbours.step
    monkeypatch.setattr(neighbours, "CELLS", 30)
    monkeypatch.setattr(neighbours, "step", lambda n: sizes.append(step(n)) or sizes[-1])
    for inside, got in ((False, neighbours.nearest(asked.drop("path"), rows.drop("path"), 3, exclude_self=True)), (True, neighbours.nearest_within(asked, rows, 3, exclude_self=True))):
        d = np.round(1 - v @ v.T, 9)
        want = {(q, b) for q in range(0, 50, 5) for b in sorted((b for b in range(50) if b != q and (not inside or b % 2 == q % 2)), key=lambda b: (d[q, b], b))[:3]}  # noqa: B023
        assert {(r["q"], r["b"]) for r in got.collect()} == want
    assert sizes == [3, 3]
