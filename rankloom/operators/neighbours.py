"""Nearest neighbours and prototypes: flat, and hierarchical with votes that multiply down the ranks.

Searches take a stated query set. The queries go out in blocks of a checked size in
bytes; each base row is scored where it lies, a batch at a time as a matrix product, and a
task keeps only each query's k nearest rows, so a shuffle sees k rows of each query and
task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.shared import written

#: Bytes of the query vectors that are broadcast at once, and base rows of one matrix product.
BLOCK, ROWS = 32 << 20, 2000
#: Queries x base rows of one matrix product at most; bounds a task's memory whatever the query set.
CELLS = 1 << 22


def matrix(column: pa.ListArray) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def step(n_queries: int) -> int:
    """Base rows of one matrix product with so many queries."""
    return max(1, min(ROWS, CELLS // max(1, n_queries)))


def _blocks(queries: DataFrame, key: str, vector: str) -> list[DataFrame]:
    told = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size(vector) + 64), F.lit(0)).alias("bytes")).first()
    n = -(-told["bytes"] // BLOCK)
    return [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


class _Nearest:
    """Each query's k nearest of the rows seen so far, by distance rounded to nine places, then by id."""

    def __init__(self, n: int, k: int):
        self.d, self.b = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def see(self, d: np.ndarray, ids: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        both, who = np.concatenate([self.d[rows], d], axis=1), np.concatenate([self.b[rows], np.broadcast_to(ids, d.shape)], axis=1)
        if both.shape[1] > 4 * self.k:  # the k-th least bounds what must be sorted
            bound = np.partition(both, self.k - 1, axis=1)[:, self.k - 1]
            most = int((both <= bound[:, None]).sum(axis=1).max())
            at = np.argpartition(both, most - 1, axis=1)[:, :most]
            both, who = np.take_along_axis(both, at, 1), np.take_along_axis(who, at, 1)
        order = np.lexsort((who, both), axis=1)[:, : self.k]
        self.d[rows], self.b[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)

    def out(self, ids: np.ndarray, names: list[str]) -> pa.RecordBatch:
        q, j = np.nonzero(np.isfinite(self.d))
        return pa.record_batch([pa.array(ids[q]), pa.array(self.b[q, j]), pa.array(self.d[q, j])], names=names)


def _distances(x: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """Rows of x against rows of y, rounded to nine places."""
    d = 1 - x @ y.T if kind == "cosine" else (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)
    return np.round(d, 9) + 0.0


def nearest(queries: DataFrame, base: DataFrame, k: int = 1, distance: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(q, b, d, place): each query's k nearest base rows, ties by id. queries: (q, qv); base: (b, bv); ids are integers; distance: cosine or squared."""
    out = None
    for block in _blocks(queries, "q", "qv"):
        held = block.select(F.col("q").cast("long").alias("q"), F.transform("qv", lambda x: x.cast("double")).alias("qv")).toArrow()  # BLOCK bytes at most
        told = base.sparkSession.sparkContext.broadcast((held.column("q").to_numpy(), matrix(held.column("qv").combine_chunks())))

        def search(batches: Iterator[pa.RecordBatch], told=told, size=step(held.num_rows)) -> Iterator[pa.RecordBatch]:
            ids, x = told.value
            best = _Nearest(len(ids), k)
            for batch in (b.slice(at, size) for b in batches for at in range(0, b.num_rows, size)):
                if len(ids) and batch.num_rows:
                    rows = batch.column(0).to_numpy(zero_copy_only=False)
                    d = _distances(x, matrix(batch.column(1)), distance)
                    best.see(np.where(rows[None, :] == ids[:, None], np.inf, d) if exclude_self else d, rows)
            yield best.out(ids, ["q", "b", "d"])

        found = base.select(F.col("b").cast("long").alias("b"), "bv").mapInArrow(search, "q long, b long, d double")
        best = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("d", "b"))).where(F.col("place") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def _path(names: list[str]):
    return F.array(*[F.col(x).cast("string") for x in names]) if names else F.array().cast("array<string>")


def nearest_within(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(q, b, d, place): each query's k nearest base rows by cosine among those with the query's path, ties by id.

    queries: (q, qv, path); base: (b, bv, path); a path is an array of strings. A path that only one side has finds nothing.
    """
    near = None
    for block in _blocks(queries, "q", "qv"):
        held = block.select(F.col("q").cast("long").alias("q"), F.transform("qv", lambda x: x.cast("double")).alias("qv"), "path").toArrow()  # BLOCK bytes at most
        groups: dict[tuple, list[int]] = {}
        for at, p in enumerate(held.column("path").to_pylist()):
            groups.setdefault(tuple(p), []).append(at)
        told = base.sparkSession.sparkContext.broadcast((held.column("q").to_numpy(), matrix(held.column("qv").combine_chunks()), {p: np.array(v) for p, v in groups.items()}))

        def search(batches: Iterator[pa.RecordBatch], told=told, size=step(held.num_rows)) -> Iterator[pa.RecordBatch]:
            ids, x, groups = told.value
            best = _Nearest(len(ids), k)
            for batch in (b.slice(at, size) for b in batches for at in range(0, b.num_rows, size)):
                rows, y = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
                own: dict[tuple, list[int]] = {}
                for at, p in enumerate(batch.column(2).to_pylist()):
                    own.setdefault(tuple(p), []).append(at)
                for p, at in own.items():
                    if p in groups:
                        d = _distances(x[groups[p]], y[at], "cosine")
                        best.see(np.where(rows[at][None, :] == ids[groups[p]][:, None], np.inf, d) if exclude_self else d, rows[at], groups[p])
            yield best.out(ids, ["q", "b", "d"])

        found = base.select(F.col("b").cast("long").alias("b"), "bv", "path").mapInArrow(search, "q long, b long, d double")
        top = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("d", "b"))).where(F.col("place") <= k)
        near = top if near is None else near.unionByName(top)
    return near


def hierarchical(queries: DataFrame, base: DataFrame, ranks: list[str], ks: list[int], size_how: str = "sqrt", exclude_self: bool = False, region: str | None = None) -> DataFrame:
    """(q, p_.., c_..): rank by rank, the k nearest base rows inside the predicted prefix vote; confidence multiplies.

    A vote weighs 1 / sqrt(size of its taxon among the candidates) times 1 / (d^2 + 1e-6); ties
    go to the larger votes, then the larger taxon, then the larger name. queries: (q, qv); base: (b, bv, ranks).
    The last of ks stands for all further ranks. With ``region``, a column of base, the result also names the
    region of the nearest row that voted for the first rank's winner.
    """
    state = queries.select(F.col("q").cast("long").alias("q"), "qv", F.lit(1.0).alias("conf"))
    done: list[str] = []
    kept: list[str] = []
    for r, rank in enumerate(ranks):
        sizes = base.groupBy(*ranks[: r + 1]).agg(F.count("*").alias("size"))
        near = nearest_within(state.select("q", "qv", _path(done).alias("path")), base.select("b", "bv", _path(ranks[:r]).alias("path")), ks[min(r, len(ks) - 1)], exclude_self)
        carried = [region] if region and not r else []
        named = near.join(base.select(F.col("b").cast("long").alias("b"), *dict.fromkeys(ranks[: r + 1] + carried)), "b").join(sizes, ranks[: r + 1])
        closest = [F.min(F.struct("d", "b", region)).alias("closest")] if carried else []
        votes = named.withColumn("taxon", F.col(rank)).groupBy("q", "taxon").agg(F.round(F.sum(S.size_vote(F.col("size"), size_how) * S.distance_vote(F.col("d"))), 6).alias("vote"), F.max("size").alias("size"), *closest)
        won = votes.groupBy("q").agg(F.max(F.struct("vote", "size", "taxon", *(["closest"] if carried else []))).alias("w"), F.sum("vote").alias("all"))
        share = F.col("conf") * F.col("w.vote") / F.col("all")
        more = [F.col("w.closest")[region].alias("best_region")] if carried else []
        state = written(state.join(won, "q").select("q", "qv", share.alias("conf"), *done, *[f"c_{x}" for x in ranks[:r]], *kept, F.col("w.taxon").alias(f"p_{rank}"), share.alias(f"c_{rank}"), *more), "voted")
        done.append(f"p_{rank}")
        kept = ["best_region"] if region else []
    return state.select("q", *done, *[F.round(f"c_{x}", 6).alias(f"c_{x}") for x in ranks], *kept)


def centroids(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, n, resultant, centroid): the normalised sum of unit vectors, and the length of their mean. Sums are partial before the shuffle."""
    dims = rows.select(*by, F.posexplode(S.normalised(F.col(vector))).alias("at", "x")).groupBy(*by, "at").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    packed = dims.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("sum"))
    return packed.select(*by, "n", (F.sqrt(S.dot(F.col("sum"), F.col("sum"))) / F.col("n")).alias("resultant"), S.normalised(F.col("sum"), 1e-12, "safe").alias("centroid"))


def prototype_classes(queries: DataFrame, protos: DataFrame, label: str, kappa: float = 0.02, size_alpha: float | None = None, quality_alpha: float | None = None) -> DataFrame:
    """(q, predicted, confidence): the most similar centroid (the first name of equals) and its softmax share at temperature kappa.

    size_alpha and quality_alpha damp a similarity by n / (n + alpha) and by the resultant over (n + alpha). Prototypes
    are one row for each taxon; they go out in blocks of a checked size, and queries are scored where they lie.
    """
    factor = F.lit(1.0)
    if size_alpha is not None:
        factor = factor * F.col("n") / (F.col("n") + size_alpha)
    if quality_alpha is not None:
        factor = factor * F.col("resultant") * F.col("n") / (F.col("n") + quality_alpha)
    kind = protos.schema[label].dataType.simpleString()
    parts = None
    for block in _blocks(protos, label, "centroid"):
        held = block.select(F.col(label).alias("label"), "centroid", factor.alias("factor")).orderBy("label").toArrow()  # BLOCK bytes at most
        told = protos.sparkSession.sparkContext.broadcast((held.column("label").to_pylist(), matrix(held.column("centroid").combine_chunks()), held.column("factor").to_numpy()))

        def judge(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            names, c, f = told.value
            for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
                if names and batch.num_rows:
                    x = matrix(batch.column(1))
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
                    sim = np.round((x @ c.T) * f, 9)
                    top, whole = sim.argmax(axis=1), sim.max(axis=1)
                    rest = np.exp((sim - whole[:, None]) / kappa).sum(axis=1)
                    yield pa.record_batch([batch.column(0), pa.array([names[k] for k in top]), pa.array(whole), pa.array(rest)], names=["q", "label", "sim", "rest"])

        got = queries.select(F.col("q").cast("long").alias("q"), "qv").mapInArrow(judge, f"q long, label {kind}, sim double, rest double")
        parts = got if parts is None else parts.unionByName(got)
    # Blocks of prototypes meet by their own maxima.
    top = parts.groupBy("q").agg(F.max("sim").alias("most"), F.min_by("label", F.struct(-F.col("sim"), F.col("label"))).alias("predicted"), F.collect_list(F.struct("sim", "rest")).alias("all"))
    share = 1 / F.aggregate("all", F.lit(0.0), lambda s, x: s + x["rest"] * F.exp((x["sim"] - F.col("most")) / kappa))
    return top.select("q", "predicted", F.round(share, 6).alias("confidence"))
