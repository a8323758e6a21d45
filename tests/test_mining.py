"""Selection, weighted representatives and mining over batches, against plain readings."""

import math
import os
import random
import shutil

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from rankloom.operators import batches, crossed, curation, mining, selection
from rankloom.plans import shared
from rankloom.plans.shared import Scratch, written


@pytest.mark.parametrize("seed, spread, ranges", [(2, 1 << 62, 4096), (3, 3, 2), (4, 100_000, 16)])
def test_first_rows_equal_a_sort(spark, monkeypatch, seed, spread, ranges):
    monkeypatch.setattr(selection, "RANGES", ranges)
    draw = random.Random(seed)
    rows = [(draw.choice([-1, 0, 3, None]), draw.randrange(-spread, spread), draw.randrange(5 if seed == 3 else 1 << 62), k) for k in range(400)]
    df = spark.createDataFrame(rows, "rank int, o long, t long, id long")
    for cap in (0, 7, {0: 5, 3: 1_000}):
        got = selection.first_rows(df, "rank", "o", "t", cap).collect()
        for g in (-1, 0, 3, None):
            n = cap if isinstance(cap, int) else cap.get(g, 0)
            mine, want = sorted((r["o"], r["t"]) for r in got if r["rank"] == g), sorted((o, t) for r, o, t, _ in rows if r == g)
            assert mine == want[:n]
    assert selection.first_rows(df.limit(0), "rank", "o", "t", 3).count() == 0
    short = {r["rank"]: (r["wanted"], r["have"], r["short"]) for r in selection.shortages(df, "rank", 1_000).collect()}
    assert short[0] == (1_000, sum(r[0] == 0 for r in rows), 1_000 - sum(r[0] == 0 for r in rows)) and len(short) == 4


def test_representatives_prefer_small_taxa(spark):
    draw = random.Random(5)
    sizes = {i: [draw.choice([1, 5, 40]), draw.choice([1, 2, 9])] for i in range(60)}
    pairs = [(i, j, draw.choice([-1, 0, 1, 7])) for i in range(60) for j in range(i + 1, 60)]
    baselines, power = [5.0, 2.0], 0.8
    df = spark.createDataFrame(pairs, "i long, j long, rank int")
    got = mining.balancing_weights(df, spark.createDataFrame([(i, s) for i, s in sizes.items()], "id long, sizes array<long>"), baselines, power, clip=3.0)
    weight = {(i, j): min(3.0, (baselines[r] ** 2 / (sizes[i][r] * sizes[j][r] + 1e-12)) ** power) if 0 <= r < 2 else 1.0 for i, j, r in pairs}
    assert all(abs(r["weight"] - weight[r["i"], r["j"]]) < 1e-9 for r in got.collect())
    key = lambda i, j: i * 1_000_003 + j
    uniform = lambda k: ((k % 2147483648 * 1103515245 + 12345) % 2147483648 + 0.5) / 2147483648
    chosen = {(r["i"], r["j"]) for r in mining.representatives(got, F.col("i") * 1_000_003 + F.col("j"), 50, F.col("weight")).collect()}
    want = set()
    for rank in (-1, 0, 1, 7):
        mine = [(i, j) for i, j, r in pairs if r == rank]
        draws = {p: round(math.log(weight[p]) - math.log(-math.log(uniform(key(*p)))), 9) for p in mine}
        want |= set(sorted(mine, key=lambda p: (-draws[p], key(*p)))[:50])
    assert chosen == want


def test_many_of_a_taxon_go_by_places(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "ab"[k % 3 == 0]) for k in range(200)], "id long, r0 string")
    want = {r["id"] for r in curation.most_per_taxon(rows, [["r0"]], 40, F.col("id")).collect()}
    monkeypatch.setattr(curation, "RANKED", 10)
    assert {r["id"] for r in curation.most_per_taxon(rows, [["r0"]], 40, F.col("id")).collect()} == want and len(want) == 80


def _points(spark):
    draw = random.Random(7)
    rows = []
    for k in range(90):
        label = k % 6
        v = [math.cos(label) + draw.gauss(0, 0.3), math.sin(label) + draw.gauss(0, 0.3), draw.gauss(0, 0.3)]
        n = math.sqrt(sum(x * x for x in v))
        rows.append((k, label % 2, label, [x / n for x in v]))
    return spark.createDataFrame(rows, "key long, top long, label long, v array<double>")


def _told(spark, folder, n, sizes):
    out = []
    for b in range(1, n + 1):
        pairs, triplets = batches.batch_rows(spark, folder, b, sizes)
        out.append((sorted(tuple(r) for r in pairs.select("batch", "place", "i", "j", "rank").collect()), sorted(tuple(r) for r in triplets.select("batch", "place", "anchor", "positive", "negative").collect())))
    return out


def test_batches_go_on_where_a_run_was_stopped(spark, tmp_path):
    rows, sizes = _points(spark), (10, 8)
    how = dict(anchors=F.lit(True), lookup={0: 0.8, 1: 0.3}, across=1.6, share=0.7, copies=0.5, other_view=F.reverse, uniform_until=1, done_at=4)
    args = (rows, "key", ["top", "label"], "v")
    whole = batches.run_batches(*args, f"{tmp_path}/a", 5, sizes, ahead=3, **how).orderBy("batch").collect()
    assert [r["run"] for r in whole] == [1, 1, 1, 4, 4] and [r["pairs_from"] for r in whole] == [0, 10, 20, 0, 10]
    # A plain reading: mine when the cache is short, from the hardness that the run before left.
    states, want = (None, None), []
    for run in (1, 4):
        keep = Scratch(spark)
        pairs, triplets, states = mining.mine_batch(*args, run, states=states, totals=(30, 24), **how)
        pairs, triplets, states = keep.write(pairs, "p").collect(), keep.write(triplets, "t").collect(), tuple(keep.write(s, "s") for s in states)
        for b in range(run, min(run + 3, 6)):
            part = lambda df, n, cols: sorted((b, r["position"] - (b - run) * n, *[r[c] for c in cols]) for r in df if (b - run) * n <= r["position"] < (b - run + 1) * n)  # noqa: B023, E731
            want.append((part(pairs, 10, ("i", "j", "rank")), part(triplets, 8, ("anchor", "positive", "negative"))))
    assert _told(spark, f"{tmp_path}/a", 5, sizes) == want and all(len(p) == 10 and len(t) == 8 for p, t in want)
    # Stopped when the fourth batch had written a part of its run.
    os.makedirs(f"{tmp_path}/b/state")
    for part in ("run=1", "state/batch=1", "state/batch=2", "state/batch=3"):
        shutil.copytree(f"{tmp_path}/a/{part}", f"{tmp_path}/b/{part}")
    rows.limit(3).write.parquet(f"{tmp_path}/b/run=4/pairs")
    batches.run_batches(*args, f"{tmp_path}/b", 5, sizes, ahead=3, **how)
    assert _told(spark, f"{tmp_path}/b", 5, sizes) == want


def test_mining_of_written_pairs_writes_only_what_may_be_drawn(spark, monkeypatch):
    """Pairs that come once are scanned: the same rows as by grouping them all, and no table as large as theirs is written on the way."""
    draw = random.Random(4)
    pairs = [(i, j, draw.choice([-1, -1, 0, 0, 1]), draw.choice([0.4, 0.9, 1.5]), round(draw.random() * 2, 9)) for i in range(10) for j in range(10, 300)]
    pairs = written(spark.createDataFrame(pairs, "i long, j long, rank int, true double, pred double"), "pairs")
    sizes = spark.createDataFrame([(k, [1 + k % 7, 1 + k % 3]) for k in range(300)], "id long, sizes array<long>")
    counts, write = [], Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        counts.append(out.count())
        return out

    how = {"sizes": sizes, "baselines": [2.0, 2.0]}

    def rows(**once) -> list:
        found = [mining.mine_triplets(pairs, [0, 1], 40, 60, **once)[0], mining.mine_pairs(pairs, 40, 60, **once, **how)[0]]
        return [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in found]

    whole = rows()
    monkeypatch.setattr(mining, "SPARE", 2)
    monkeypatch.setattr(Scratch, "write", counted)
    assert rows(once=True) == whole and all(whole)
    # The weighted draw may take all rows of two ranks in before it is sure; the triplets never do.
    assert max(counts[:4]) < 1_000 < pairs.count()


def test_redrawn_positives_of_a_large_group(spark, monkeypatch):
    """A large group's keys are dealt over several counted tasks by blocks of draws; every draw is the largest of all its keys."""
    monkeypatch.setattr(mining, "DRAWS", 500)
    rows = [(1, 1, 100 + k, k / 60) for k in range(60)] + [(2, 2, 7, 0.5), (2, 2, 7, 0.5), (3, 1, 8, 0.1)]
    got = mining.redrawn_positives(spark.createDataFrame(rows, "anchor long, rank int, positive long, pred double"), None, 2.0)
    found = {(r["anchor"], r["rank"], r["draw"]): r["positive"] for r in got.collect()}
    groups = {(1, 1): rows[:60], (2, 2): rows[60:62], (3, 1): rows[62:]}
    key = lambda a, r, p, pred, draw: (round(2 * pred - math.log(-math.log((((a * 100003 + p * 17 + draw * 7919 + r * 131) * 1103515245 + 12345) % 2**31 + 0.5) / 2**31)), 9), p)
    assert found == {(a, r, draw): max(key(*row, draw) for row in held)[1] for (a, r), held in groups.items() for draw in range(1, len(held) + 1)}
    parts = got.withColumn("part", F.spark_partition_id()).where("anchor = 1").groupBy("part").count().collect()
    assert len(parts) > 1 and got.count() == 63


def test_pairs_made_anew_are_mined_like_written_ones(spark, monkeypatch):
    """Labels, drops, draws, distances and negatives of pairs that are never rows equal those of a written table of them."""
    monkeypatch.setattr(shared, "QUERIES", 15)
    monkeypatch.setattr(shared, "PAIRS", 1_500)
    monkeypatch.setattr(mining, "SPARE", 1)
    draw = random.Random(11)
    data = [(k, draw.choice("ab"), draw.choice(["x", "y", "z", None]), None if k in (7, 20) else [draw.gauss(0, 1) for _ in range(4)], [draw.choice([3, 30, 60]), draw.choice([2, 9])]) for k in range(200)]
    data = [(k, a, b, v and [x / math.sqrt(sum(y * y for y in v)) for x in v], s) for k, a, b, v, s in data]
    rows = written(spark.createDataFrame(data, "id long, r0 string, r1 string, v array<double>, sizes array<long>"), "rows")
    sizes, asked, lookup, baselines = rows.select("id", "sizes"), F.col("id") % 7 == 0, {0: 0.8, 1: 0.3}, [30.0, 4.0]
    more = spark.createDataFrame([(k, 1_000 + k, 7, 0.0, k / 50) for k in range(40)], "i long, j long, rank int, true double, pred double")
    plain = mining.labelled_pairs(rows, "id", ["r0", "r1"], "v", lookup, 1.6, asked)
    plain = mining.dropped_by_rank(plain, {-1: 0.5}, F.col("i") * 1_000_003 + F.col("j"), 4)
    plain = written(mining.thinned_by_size(plain, sizes, baselines, 0.5, 0.1, 0.2, 4).unionByName(more).where("rank >= -1"), "labelled")
    how = {"keep": {-1: 0.5}, "baselines": baselines, "alpha": 0.5, "floor": 0.1, "warm": 0.2, "seed": 4}
    anew = crossed.Crossed(rows, "id", ["r0", "r1"], "v", lookup, 1.6, asked, how, more, Scratch(spark))
    whole = sorted(map(tuple, anew.above(dict.fromkeys((-1, 0, 1, 7), 0)).fillna(9.0).collect()))
    assert whole == sorted(map(tuple, mining._oriented(plain).fillna(9.0).select("i", "j", "rank", "true", "pred").collect())) and len(whole) == sum(n for ranges in anew.counted().values() for n in ranges.values())
    every = spark.createDataFrame([(k, r) for k in range(200) for r in (0, 1)], "anchor long, rank int")
    want = mining._drawn_negatives(mining._oriented(plain), every, 1.0, 4, Scratch(spark))
    assert sorted(map(tuple, anew.negatives(every, 1.0, 4).collect())) == sorted(map(tuple, want.collect()))

    def mined(pairs, **once) -> list:
        hard, triples, _ = mining.mine(pairs, 0, 25, 60, 30, 50, [0, 1], seed=4, sizes=sizes, baselines=baselines, **once)
        return [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in (hard, triples)]

    got = mined(anew)
    assert got == mined(plain, once=True) and all(got)


def test_a_batch_is_mined_without_writing_its_pairs(spark, monkeypatch):
    draw = random.Random(3)
    rows = spark.createDataFrame([(k, k % 2, k % 4, [draw.gauss(0, 1) for _ in range(3)]) for k in range(300)], "key long, top long, label long, v array<double>")
    counts, write = {}, DataFrameWriter.parquet

    def counted(self, path, *args, **kw):
        write(self, path, *args, **kw)
        counts[path] = spark.read.parquet(path).count()

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    pairs, triplets, _ = mining.mine_batch(rows, "key", ["top", "label"], "v", 3, F.lit(True), {0: 0.8, 1: 0.3}, 1.6, share=0.8, other_view=F.reverse, caps=(20, 20), totals=(30, 30))
    assert pairs.count() and triplets.count()
    # 240 rows have 28,680 pairs; ranges of hashes are at most 2,048 for each of four ranks.
    assert max(counts.values()) < 12_000
