"""Seven-rank classification against a plain reading, one query at a time."""

import math

import numpy as np
import pytest

from rankloom.operators import classification, neighbours

RANKS = [f"t{k}" for k in range(4)]


def rows_of(n: int, seed: int) -> list[tuple]:
    """(b, unit vector, four ranks, region); every third vector is another's copy, one domain has one phylum."""
    rng, out = np.random.default_rng(seed), []
    for b in range(n):
        v = rng.normal(size=6) + 2 * np.eye(6)[b % 3]
        v = out[b - 1][1] if b % 3 == 2 else (v / np.linalg.norm(v)).tolist()
        d = "de"[b % 2]
        path = [d, d + ("0" if d == "e" else str(b % 4))]
        path += [path[1] + str(b % 5), path[1] + str(b % 5) + str(b % 7 // 3)]
        out.append((b, v, *path, f"R{b % 4}"))
    return out


def voted(x, rows, ks):
    """Names, confidences and the best region, rank by rank, as sums over sorted candidates."""
    prefix, conf, names, confs, best = [], 1.0, [], [], ""
    for r in range(len(RANKS)):
        inside = [t for t in rows if list(t[2 : 2 + r]) == prefix]
        near = sorted((round(1 - float(np.dot(x, t[1])), 9), t[0], t) for t in inside)[: ks[min(r, len(ks) - 1)]]
        size = {n: sum(t[2 + r] == n for t in inside) for n in {t[2 + r] for t in inside}}
        votes = {}
        for d, _, t in near:
            votes[t[2 + r]] = votes.get(t[2 + r], 0) + 1 / math.sqrt(size[t[2 + r]]) / (d * d + 1e-6)
        win = max(votes, key=lambda n: (round(votes[n], 6), size[n], n))
        conf *= votes[win] / sum(votes.values())
        if r == 0:
            best = next(t[-1] for _, _, t in near if t[2] == win)
        prefix.append(win)
        names.append(win)
        confs.append(conf)
    return names, confs, best


def competed(x, rows, kappa, size_alpha, quality_alpha):
    prefix, conf, names, confs = [], 1.0, [], []
    for r in range(len(RANKS)):
        inside = [t for t in rows if list(t[2 : 2 + r]) == prefix]
        sims = {}
        for name in sorted({t[2 + r] for t in inside}):
            own = np.array([t[1] for t in inside if t[2 + r] == name])
            total, n = own.sum(0), len(own)
            length = np.linalg.norm(total)
            sim = float(np.dot(x, total / length))
            sim *= n / (n + size_alpha) if size_alpha is not None else 1
            sim *= length / (n + quality_alpha) if quality_alpha is not None else 1
            sims[name] = round(sim, 9)
        win = max(sims, key=lambda n: sims[n])
        if len(sims) > 1:
            conf /= sum(math.exp((s - sims[win]) / kappa) for s in sims.values())
        prefix.append(win)
        names.append(win)
        confs.append(conf)
    inside = [t for t in rows if list(t[2 : 2 + len(RANKS)]) == prefix]
    return names, confs, min((round(1 - float(np.dot(x, t[1])), 9), t[0], t[-1]) for t in inside)[2]


def tables(spark, seed=3):
    rows, asked = rows_of(90, seed), rows_of(12, seed + 1)
    base = spark.createDataFrame(rows, "b long, bv array<double>, " + ", ".join(f"{r} string" for r in RANKS) + ", region string")
    return rows, asked, base, spark.createDataFrame([(t[0], t[1]) for t in asked], "q long, qv array<double>")


def same(got, names, confs, region):
    assert [got[f"p_{r}"] for r in RANKS] == names and got["best_region"] == region
    assert [got[f"c_{r}"] for r in RANKS] == pytest.approx(confs, abs=2e-6)


def test_votes_down_the_ranks(spark):
    rows, asked, base, queries = tables(spark)
    got = {r["q"]: r for r in neighbours.hierarchical(queries, base, RANKS, [9, 6, 3], region="region").collect()}
    assert len(got) == len(asked)
    for t in asked:
        same(got[t[0]], *voted(t[1], rows, [9, 6, 3]))


@pytest.mark.parametrize("alphas", [(None, None), (1.0, None), (2.0, 1.0)])
def test_prototypes_down_the_ranks(spark, alphas, monkeypatch):
    rows, asked, base, queries = tables(spark, 7)
    if alphas[0] == 2.0:  # many blocks of prototypes
        monkeypatch.setattr(neighbours, "BLOCK", 500)
    got = {r["q"]: r for r in classification.prototype_hierarchy(queries, base, RANKS, 0.1, *alphas, region="region").collect()}
    assert len(got) == len(asked)
    for t in asked:
        same(got[t[0]], *competed(t[1], rows, 0.1, *alphas))


def test_paths_that_end(spark):
    """No taxon at a rank, no query, no base row."""
    base = spark.createDataFrame([(1, [1.0, 0.0], "a", None, "R1"), (2, [0.0, 1.0], "b", "c", "R2")], "b long, bv array<double>, t0 string, t1 string, region string")
    queries = spark.createDataFrame([(5, [1.0, 0.1])], "q long, qv array<double>")
    got = classification.prototype_hierarchy(queries, base, ["t0", "t1"], region="region").collect()
    assert [(r["p_t0"], r["p_t1"], r["c_t1"], r["best_region"]) for r in got] == [("a", "", 0.0, "")]
    assert classification.prototype_hierarchy(queries.limit(0), base, ["t0", "t1"], region="region").count() == 0
    none = classification.prototype_hierarchy(queries, base.limit(0), ["t0"], region="region").collect()
    assert [(r["p_t0"], r["c_t0"], r["best_region"]) for r in none] == [("", 0.0, "")]
