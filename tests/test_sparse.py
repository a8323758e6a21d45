"""Sparse neighbours and projections of wide vectors against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import clustering, evaluation, kmers, sparse


@pytest.mark.parametrize("products, cells", [(50, 100), (1 << 21, 1 << 22)])
def test_sparse_neighbours_equal_dense_ones(spark, monkeypatch, products, cells):
    monkeypatch.setattr(sparse, "PRODUCTS", products)
    monkeypatch.setattr(sparse, "CELLS", cells)
    draw = np.random.default_rng(2)
    roots = ["".join(draw.choice(list("ACGT"), 300)) for _ in range(6)]
    seqs = ["".join(c if draw.random() > 0.05 else "A" for c in roots[k % 6]) for k in range(80)] + ["ACG", "", roots[0], roots[0]]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, s string").repartition(3)
    v = sparse.unit_vectors(kmers.kmer_counts(df, "id", "s", 7), "id")
    got = sparse.nearest(v.where("id % 4 = 0").select(F.col("id").alias("q"), "at", "x"), v.select(F.col("id").alias("b"), "at", "x"), 3, exclude_self=True).collect()
    names = sorted({s[k : k + 7] for s in seqs for k in range(len(s) - 6)})
    x = np.array([[sum(s[k : k + 7] == n for k in range(len(s) - 6)) for n in names] for s in seqs], float)
    norm = np.linalg.norm(x, axis=1)
    ok = norm > 0
    x[ok] /= norm[ok, None]
    asked = [k for k in range(len(seqs)) if k % 4 == 0 and ok[k]]
    assert {r["q"] for r in got} == set(asked) and len(got) == 3 * len(asked)
    for q in asked:
        d = np.round(1 - x @ x[q], 9)
        want = sorted((d[b], b) for b in range(len(seqs)) if b != q and ok[b])[:3]
        mine = sorted((r["place"], r["d"]) for r in got if r["q"] == q)
        assert np.allclose([m[1] for m in mine], [w[0] for w in want], atol=2e-9)
        assert all(r["n_scored"] <= ok.sum() for r in got)


def test_few_pairs_of_sparse_vectors_are_scored():
    draw = np.random.default_rng(7)
    roots = draw.random((20, 3000)) * (draw.random((20, 3000)) < 0.03)
    x = roots[np.arange(1200) % 20] * (draw.random((1200, 3000)) > 0.1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = [np.flatnonzero(v) for v in x]
    block = sparse.Queries(np.arange(0, 1200, 10), at[::10], [x[k][at[k]] for k in range(0, 1200, 10)])
    best, pairs = sparse._Nearest(120, 3), 0
    for low in range(0, 1200, 100):
        ids = np.arange(low, low + 100)
        pairs += block.see(best, ids, np.repeat(np.arange(100), [len(at[k]) for k in ids]), np.concatenate([at[k] for k in ids]), np.concatenate([x[k][at[k]] for k in ids]), True)[1]
    d = np.round(1 - x[::10] @ x.T, 9)
    d[np.arange(120), np.arange(0, 1200, 10)] = np.inf
    assert np.allclose(best.d, np.sort(d, axis=1)[:, :3], atol=2e-9)
    assert np.allclose(np.take_along_axis(d, best.b, 1), best.d, atol=2e-9)
    assert pairs < 120 * 1200 / 4


def test_sparse_neighbours_of_nothing(spark):
    v = spark.createDataFrame([], "id long, at array<long>, x array<double>")
    one = spark.createDataFrame([(1, [5], [1.0])], "id long, at array<long>, x array<double>")
    for q, b in ((v, one), (one, v), (v, v)):
        assert sparse.nearest(q.withColumnRenamed("id", "q"), b.withColumnRenamed("id", "b")).count() == 0


def test_projection_of_wide_vectors_equals_the_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(clustering, "MORE", 10)
    monkeypatch.setattr(clustering, "WIDE", 32)
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 150)) * np.concatenate([[9, 6, 4], np.full(147, 0.5)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = np.array([[r["x0"], r["x1"]] for r in clustering.projection(df, "id", "v").orderBy("id").collect()])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u - u.mean(axis=0)
    _, axes = np.linalg.eigh(c.T @ c)
    axes = axes[:, ::-1][:, :2]
    want = c @ (axes * np.sign(axes.sum(axis=0)))
    assert np.allclose(got, want, atol=1e-6)


def test_expected_information_of_large_margins():
    def plain(a, b, n):
        lg = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
        k = np.arange(max(1, a + b - n), min(a, b) + 1)
        logs = lg[a] + lg[b] + lg[n - a] + lg[n - b] - lg[n] - lg[k] - lg[a - k] - lg[b - k] - lg[n - a - b + k]
        return (k / n * np.log(n * k / (a * b)) * np.exp(logs)).sum()

    draw = np.random.default_rng(3)
    for _ in range(300):
        n = int(draw.integers(1, 3_000))
        a, b = int(draw.integers(1, n + 1)), int(draw.integers(1, n + 1))
        assert abs(evaluation.expected_information(a, b, n) - plain(a, b, n)) < 1e-9 * max(1, abs(plain(a, b, n)))
    wide = evaluation.expected_information(300_000_000, 500_000_000, 1_000_000_000)
    assert 0 < wide < 1e-6  # about 1 / 2n for large margins


def test_rows_are_bounded_on_all_coordinates_that_are_laid_out(monkeypatch):
    """Weight on very many coordinates leaves no slack: hardly more pairs are scored than are wanted, from the first rows on."""
    monkeypatch.setattr(sparse, "WIDE", 16)
    draw = np.random.default_rng(9)
    at = [np.sort(draw.choice(9_000, 60, replace=False)) for _ in range(900)]
    x = [v / np.linalg.norm(v) for v in draw.random((900, 60))]
    dense = np.zeros((900, 9_000))
    for k in range(900):
        dense[k, at[k]] = x[k]
    block, best, pairs = sparse.Queries(np.arange(0, 900, 15), at[::15], x[::15]), sparse._Nearest(60, 3), 0
    for low in range(0, 900, 300):
        ids = np.arange(low, low + 300)
        pairs += block.see(best, ids, np.repeat(np.arange(300), 60), np.concatenate(at[low : low + 300]), np.concatenate(x[low : low + 300]), True)[1]
    d = np.round(1 - dense[::15] @ dense.T, 9)
    d[np.arange(60), np.arange(0, 900, 15)] = np.inf
    assert np.allclose(best.d, np.sort(d, axis=1)[:, :3], atol=2e-9) and np.allclose(np.take_along_axis(d, best.b, 1), best.d, atol=2e-9)
    assert pairs < 60 * 3 * 4
