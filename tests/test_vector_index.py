"""The neighbour index against comparing with every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import vector_index
from rankloom.plans import adapters as A


def rows(seed: int, n: int, dims: int, groups: int, unit: bool):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(groups, dims))[draw.integers(0, groups, n)] + draw.normal(scale=0.15, size=(n, dims))
    x[:20] = x[0]  # copies, which tie
    return x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x


@pytest.mark.parametrize("distance, unit", [("cosine", True), ("squared", False), ("cosine", False)])
def test_index_is_exact_and_compares_less(spark, distance, unit):
    x = rows(1, 1_500, 8, 30, unit)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "b long, bv array<double>").repartition(3)
    q = df.where("b % 15 = 0").select(F.col("b").alias("q"), F.col("bv").alias("qv"))
    index = vector_index.build(df, 24)
    got = vector_index.search(q, index, 4, distance, exclude_self=True).collect()
    asked = np.arange(0, 1_500, 15)
    d = np.round(1 - x[asked] @ x.T if distance == "cosine" else ((x[asked][:, None] - x[None]) ** 2).sum(2), 9) + 0.0
    d[np.arange(len(asked)), asked] = np.inf
    want = np.lexsort((np.broadcast_to(np.arange(1_500), d.shape), d), axis=1)[:, :4]
    found = {(r["q"], r["place"]): r["b"] for r in got}
    near = {(r["q"], r["place"]): r["d"] for r in got}
    assert len(got) == 4 * len(asked)
    for k, a in enumerate(asked):
        for p in range(4):
            assert abs(near[a, p + 1] - d[k, want[k, p]]) < 1e-8
    if distance == "cosine":
        assert all(found[a, p + 1] == want[k, p] for k, a in enumerate(asked) for p in range(4))
    share = np.mean([r["n_compared"] for r in got]) / 1_500
    assert share < (0.5 if unit or distance == "squared" else 1.01)
    some = vector_index.search(q, index, 4, distance, exclude_self=True, probes=6).collect()
    recall = len({(r["q"], r["b"]) for r in some} & {(r["q"], r["b"]) for r in got}) / len(got)
    assert recall >= 0.9 or not unit


def test_index_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "b long, bv array<double>")
    q = df.select(F.col("b").alias("q"), F.col("bv").alias("qv"))
    got = vector_index.search(q, vector_index.build(df, 9), 3).orderBy("q", "place").collect()
    assert [(r["q"], r["b"], r["n_compared"]) for r in got] == [(1, 1, 2), (1, 2, 2), (2, 2, 2), (2, 1, 2)]
    assert vector_index.search(q.limit(0), vector_index.build(df, 9), 3).count() == 0
    assert vector_index.search(q, vector_index.build(df.limit(0), 9), 3).count() == 0


def test_share_compared_of_the_given_vectors(spark, sf):
    v = A.vecs(spark, sf).select(F.col("vec_id").alias("b"), F.col("v").alias("bv"))
    q = v.where("b % 100 = 0").select(F.col("b").alias("q"), F.col("bv").alias("qv"))
    n, got = v.count(), vector_index.search(q, vector_index.build(v, 16), 5, exclude_self=True).collect()
    assert len(got) == 5 * q.count() and all(0 < r["n_compared"] <= n for r in got)
