"""Exact nearest neighbours by inverted lists: coarse centroids, bounds by the triangle inequality, exact scores.

Centroids are fitted on a bounded sample; every row is then put on the list of its nearest
one, with its distance to it. For a query, a list whose rows lie between two distances from their centroid can't hold
anything nearer than the gap between that ring and the query's own distance to the
centroid. A search first scores the nearest lists for a bound, then every row of the others
whose ring position is within it. With ``probes`` alone it is approximate. Lists are written
sorted, in files of about equal size: a long list goes over many files, so no task has a whole list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Scratch
from .neighbours import ROWS, _blocks, _distances, _Nearest, matrix

#: Rows that centroids are fitted on at most, rounds of fitting, lists that give a query its first bound.
SAMPLE, ROUNDS, PROBES = 20_000, 12, 4
#: Added to bounds against rounding; distances are rounded to nine places.
SLACK = 1e-7


def fitted(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centroids (fewer for fewer rows) of a sample in its order: Lloyd's rounds from rows that lie far apart."""
    if not len(rows):
        return np.zeros((0, rows.shape[1] if rows.ndim == 2 else 0))
    centres = rows[:: max(1, len(rows) // k)][:k].copy()
    for _ in range(rounds):
        at = _squared(rows, centres).argmin(axis=1)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, rows)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0.0)


@dataclass
class Index:
    """lists: (cell, ring, b, bv), ring being a row's distance to its centroid; rings: least and greatest of each cell; norms: squared lengths lie between these two."""

    lists: DataFrame
    centres: np.ndarray
    rings: np.ndarray
    norms: tuple[float, float]
    rows: int


def build(base: DataFrame, cells: int = 256, scratch: Scratch | None = None) -> Index:
    """The index of base (b, bv). Centroids come from the SAMPLE rows with the smallest hashes of their ids; every row is put on a list."""
    scratch = scratch or Scratch(base.sparkSession)
    rows = base.select(F.col("b").cast("long").alias("b"), F.transform("bv", lambda x: x.cast("double")).alias("bv"))
    n = rows.count()
    drawn = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("b"), F.lit(1 << 20)) < F.lit(min(1 << 20, int(1.2 * SAMPLE * (1 << 20) / n) + 1)))
    sample = matrix(drawn.orderBy(F.xxhash64("b"), "b").limit(SAMPLE).select("bv").toArrow().column("bv").combine_chunks())
    told = base.sparkSession.sparkContext.broadcast(fitted(sample, cells))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            d = _squared(matrix(batch.column(1)), told.value)
            at = d.argmin(axis=1)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(np.sqrt(d[np.arange(len(at)), at])), *batch.columns], names=["cell", "ring", "b", "bv"])

    if not len(told.value):
        return Index(rows.limit(0).select(F.lit(0).alias("cell"), F.lit(0.0).alias("ring"), "b", "bv"), told.value, np.zeros((0, 2)), (1.0, 1.0), 0)
    lists = rows.mapInArrow(assign, "cell int, ring double, b long, bv array<double>").repartitionByRange("cell", "ring", "b").sortWithinPartitions("cell", "ring", "b")
    lists = scratch.write(lists, "lists")
    length = F.aggregate("bv", F.lit(0.0), lambda s, x: s + x * x)
    rings = np.tile([np.inf, -np.inf], (len(told.value), 1))
    least, most = np.inf, -np.inf
    for r in lists.groupBy("cell").agg(F.min("ring").alias("a"), F.max("ring").alias("z"), F.min(length).alias("s"), F.max(length).alias("l")).collect():  # one row for each cell
        rings[r["cell"]] = r["a"], r["z"]
        least, most = min(least, r["s"]), max(most, r["l"])
    return Index(lists, told.value, rings, (least, most), n)


def _reach(x: np.ndarray, kth: np.ndarray, norms: tuple[float, float], distance: str) -> np.ndarray:
    """How far (in plain Euclidean distance) a row may lie from each query and still be as near as its k-th."""
    if distance == "squared":
        far = kth
    else:  # 1 - x.y = (|x - y|^2 + 2 - |x|^2 - |y|^2) / 2, and no |y|^2 is over the greatest
        far = 2 * kth - 2 + (x * x).sum(1) + norms[1]
    return np.sqrt(np.maximum(far + SLACK, 0.0)) + SLACK


def search(queries: DataFrame, index: Index, k: int = 1, distance: str = "cosine", exclude_self: bool = False, probes: int | None = None) -> DataFrame:
    """(q, b, d, place, n_compared): each query's k nearest rows, ties by id, and how many rows it was compared with.

    queries: (q, qv); distance: cosine (1 minus the dot product) or squared. Exact, unless a number of probes is named:
    then only that many lists are scored for each query.
    """
    spark, out = queries.sparkSession, None
    for block in _blocks(queries, "q", "qv"):
        held = block.select(F.col("q").cast("long").alias("q"), F.transform("qv", lambda x: x.cast("double")).alias("qv")).toArrow()  # a block of counted bytes
        ids, x = held.column("q").to_numpy(), matrix(held.column("qv").combine_chunks())
        if not len(ids) or not len(index.centres):
            continue
        away = np.sqrt(_squared(x, index.centres))
        full = index.rings[:, 1] >= 0
        order = np.argsort(np.where(full, away, np.inf), axis=1, kind="stable")
        first = np.zeros(away.shape, bool)
        np.put_along_axis(first, order[:, : probes or PROBES], True, axis=1)
        first &= full
        told = spark.sparkContext.broadcast((ids, x, away, first, np.full(len(ids), np.inf)))
        near = _scan(index, told, k, distance, exclude_self)
        if probes is None:
            scratch = Scratch(spark)
            near = scratch.write(near, "near")
            best = near.where("b IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "b"))).where(F.col("n") == k).select("q", "d").toArrow()  # one row for each query of the block
            kth = np.full(len(ids), np.inf)
            at = {int(q): n for n, q in enumerate(ids)}
            for q, d in zip(best.column("q").to_pylist(), best.column("d").to_pylist(), strict=True):
                kth[at[q]] = d
            reach = _reach(x, kth, index.norms, distance)
            bound = np.maximum(away - index.rings[None, :, 1], index.rings[None, :, 0] - away)
            told = spark.sparkContext.broadcast((ids, x, away, ~first & full & (bound <= reach[:, None]), reach))
            near = near.unionByName(_scan(index, told, k, distance, exclude_self))
        best = near.where("b IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("d", "b"))).where(F.col("place") <= k)
        compared = near.where("b IS NULL").groupBy(F.col("q").alias("__q")).agg(F.sum("n_compared").alias("n_compared"))
        got = best.drop("n_compared").join(compared, F.col("q") == F.col("__q")).select("q", "b", "d", "place", "n_compared")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "q long, b long, d double, place int, n_compared long")


def _scan(index: Index, told, k: int, distance: str, exclude_self: bool) -> DataFrame:
    """(q, b, d, n_compared): the k nearest rows of each task for each query among the lists asked for, and a row without b that counts comparisons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, away, asked, reach = told.value
        best, n = _Nearest(len(ids), k), np.zeros(len(ids), np.int64)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            cell, ring = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cell):
                q = np.flatnonzero(asked[:, c])
                if not len(q):
                    continue
                here = np.flatnonzero(cell == c)
                # Rings are sorted; rows outside what any of the queries can reach aren't scored.
                low, high = np.min(away[q, c] - reach[q]), np.max(away[q, c] + reach[q])
                here = here[(ring[here] >= low) & (ring[here] <= high)]
                if not len(here):
                    continue
                rows = batch.column(2).take(pa.array(here)).to_numpy(zero_copy_only=False)
                d = _distances(x[q], matrix(batch.column(3).take(pa.array(here))), distance)
                out = np.abs(away[q, c][:, None] - ring[here][None, :]) > reach[q][:, None]
                n[q] += (~out).sum(axis=1)
                out |= exclude_self & (rows[None, :] == ids[q][:, None])
                best.see(np.where(out, np.inf, d), rows, q)
        yield best.out(ids, ["q", "b", "d"]).append_column("n_compared", pa.nulls(int(np.isfinite(best.d).sum()), pa.int64()))
        met = np.flatnonzero(n)
        yield pa.record_batch([pa.array(ids[met]), pa.nulls(len(met), pa.int64()), pa.nulls(len(met), pa.float64()), pa.array(n[met])], names=["q", "b", "d", "n_compared"])

    return index.lists.mapInArrow(run, "q long, b long, d double, n_compared long")
