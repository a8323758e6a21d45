"""Prototype classification down the ranks: each rank's centroids inside the predicted path compete, confidence multiplies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.shared import Scratch
from .neighbours import ROWS, _blocks, _path, matrix, nearest_within


def damped(size_alpha: float | None = None, quality_alpha: float | None = None) -> Column:
    """The factor of a prototype's similarity: n / (n + alpha), and the length of its members' sum over (n + alpha)."""
    factor = F.lit(1.0)
    if size_alpha is not None:
        factor = factor * F.col("n") / (F.col("n") + size_alpha)
    if quality_alpha is not None:
        factor = factor * F.col("resultant") * F.col("n") / (F.col("n") + quality_alpha)
    return factor


def vector_sums(rows: DataFrame, by: list[str], vector: Column, dims: int, n: Column) -> DataFrame:
    """(by, n, sum): vectors added place by place, one row of ``dims`` sums for each group and task before the shuffle."""
    each = rows.select(*by, n.alias("__n"), vector.alias("__v"))
    told = each.groupBy(*by).agg(F.sum("__n").alias("n"), *[F.sum(F.get("__v", F.lit(k))).alias(f"__s{k}") for k in range(dims)])
    return told.select(*by, "n", F.array(*[F.col(f"__s{k}") for k in range(dims)]).cast("array<double>").alias("sum"))


def compete(queries: DataFrame, protos: DataFrame, kappa: float) -> DataFrame:
    """(q, taxon, share): the most similar prototype with the query's path, the first name of equals, and its softmax share.

    queries: (q, qv, path); protos: (path, taxon, centroid, factor). Prototypes go out in blocks of a checked size; a query
    is scored where it lies, against those of its own path only. A query whose path has no prototype isn't in the result.
    """
    parts = None
    for block in _blocks(protos, "taxon", "centroid"):
        held = block.select("path", "taxon", "centroid", F.col("factor").cast("double").alias("factor")).orderBy("taxon").toArrow()  # BLOCK bytes at most
        groups: dict[tuple, list[int]] = {}
        for at, p in enumerate(held.column("path").to_pylist()):
            groups.setdefault(tuple(p), []).append(at)
        told = protos.sparkSession.sparkContext.broadcast((held.column("taxon").to_pylist(), matrix(held.column("centroid").combine_chunks()), held.column("factor").to_numpy(), {p: np.array(v) for p, v in groups.items()}))

        def judge(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            names, c, f, groups = told.value
            for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
                ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
                own: dict[tuple, list[int]] = {}
                for at, p in enumerate(batch.column(2).to_pylist()):
                    if tuple(p) in groups:
                        own.setdefault(tuple(p), []).append(at)
                for p, at in own.items():
                    rivals = groups[p]
                    unit = x[at] / np.maximum(np.linalg.norm(x[at], axis=1, keepdims=True), 1e-8)
                    sim = np.round((unit @ c[rivals].T) * f[rivals], 9)
                    top, most = sim.argmax(axis=1), sim.max(axis=1)
                    rest = np.exp((sim - most[:, None]) / kappa).sum(axis=1)
                    yield pa.record_batch([pa.array(ids[at]), pa.array([names[rivals[k]] for k in top]), pa.array(most), pa.array(rest)], names=["q", "taxon", "sim", "rest"])

        got = queries.select("q", F.transform("qv", lambda v: v.cast("double")).alias("qv"), "path").mapInArrow(judge, "q long, taxon string, sim double, rest double")
        parts = got if parts is None else parts.unionByName(got)
    # Blocks of prototypes meet by their own maxima: one row of each block for a query.
    top = parts.groupBy("q").agg(F.max("sim").alias("most"), F.min_by("taxon", F.struct(-F.col("sim"), F.col("taxon"))).alias("taxon"), F.collect_list(F.struct("sim", "rest")).alias("all"))
    return top.select("q", "taxon", (1 / F.aggregate("all", F.lit(0.0), lambda s, v: s + v["rest"] * F.exp((v["sim"] - F.col("most")) / kappa))).alias("share"))


def prototype_hierarchy(
    queries: DataFrame, base: DataFrame, ranks: list[str], kappa: float = 0.02, size_alpha: float | None = None, quality_alpha: float | None = None, region: str | None = None
) -> DataFrame:
    """(q, p_.., c_..): at each rank the centroids inside the path predicted so far compete; confidences are products of softmax shares.

    A rank with one candidate leaves the confidence as it is. A base row without a taxon at a rank takes no part from that rank on;
    where a path has no candidates, the prediction is empty with confidence 0, there and below. queries: (q, qv), one row for each q;
    base: (b, bv, ranks). With ``region``, a column of base, best_region is that of the base row nearest to the query
    among those of the whole predicted path (equals: the least b; empty if there is none). What the ranks wrote is removed.
    """
    scratch = Scratch(queries.sparkSession)
    one = base.where(F.col("bv").isNotNull()).select(F.size("bv")).first()
    dims = one[0] if one else 0
    # Vectors are read once: the sums of a rank are those of the rank below added up.
    rows = base.where(F.col(ranks[0]).isNotNull())
    sums = scratch.write(vector_sums(rows, ranks, S.normalised(F.col("bv")), dims, F.lit(1)), "sums")
    state = queries.select(F.col("q").cast("long").alias("q"), "qv", F.lit(1.0).alias("conf"))
    done: list[str] = []
    for r, rank in enumerate(ranks):
        sums, rows = sums.where(F.col(rank).isNotNull()), rows.where(F.col(rank).isNotNull())
        found = vector_sums(sums, ranks[: r + 1], F.col("sum"), dims, F.col("n"))
        found = found.withColumn("resultant", F.sqrt(S.dot(F.col("sum"), F.col("sum"))) / F.col("n")).withColumn("centroid", S.normalised(F.col("sum"), 1e-12, "safe"))
        protos = scratch.write(found.select(_path(ranks[:r]).alias("path"), F.col(rank).cast("string").alias("taxon"), "centroid", damped(size_alpha, quality_alpha).alias("factor")), "prototypes")
        won = compete(state.select("q", "qv", _path(done).alias("path")), protos, kappa)
        conf = F.col("conf") * F.coalesce("share", F.lit(0.0))
        told = state.join(won, "q", "left")
        state = scratch.write(told.select("q", "qv", conf.alias("conf"), *done, *[f"c_{x}" for x in ranks[:r]], F.coalesce("taxon", F.lit("")).alias(f"p_{rank}"), conf.alias(f"c_{rank}")), "judged")
        done.append(f"p_{rank}")
    out = state.select("q", *done, *[F.round(f"c_{x}", 6).alias(f"c_{x}") for x in ranks])
    if region:
        near = nearest_within(state.select("q", "qv", _path(done).alias("path")), rows.select("b", "bv", _path(ranks).alias("path")), 1)
        best = near.join(base.select(F.col("b").cast("long").alias("b"), F.col(region).cast("string").alias("best_region")), "b").select("q", "best_region")
        out = out.join(best, "q", "left").withColumn("best_region", F.coalesce("best_region", F.lit("")))
    return scratch.result(out, "classified")
