"""Spherical and Euclidean k-means seeded with label means, and a kernel projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Scratch, written
from . import evaluation, neighbours, ordering
from .neighbours import matrix


def _assign(centres: np.ndarray, spherical: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            if spherical:
                at = (x @ centres.T).argmax(axis=1) if len(x) else np.empty(0, int)
            else:
                at = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(axis=1) if len(x) else np.empty(0, int)
            yield pa.record_batch([b.column(0), pa.array(at, pa.int64())], names=["id", "cluster"])

    return run


def _summed(at: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of x by cluster."""
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted(at[order], np.arange(k))
    out, full = np.zeros((k, x.shape[1])), np.flatnonzero(np.bincount(at, minlength=k))
    if len(full):
        out[full] = np.add.reduceat(x[order], cut[full])
    return out


def _sums(centres: np.ndarray, spherical: bool):
    """Per partition one row for each cluster: its count and vector sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), int)
        for b in batches:
            x = matrix(b.column(1)).reshape(b.num_rows, centres.shape[1])
            at = (x @ centres.T).argmax(axis=1) if spherical else ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(axis=1)
            total += (at[None, :] == np.arange(len(centres))[:, None]).astype(float) @ x if len(centres) <= 64 else _summed(at, x, len(centres))
            n += np.bincount(at, minlength=len(centres))
        yield pa.record_batch([pa.array(range(len(centres)), pa.int64()), pa.array(n, pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["cluster", "n", "total"])

    return run


def _added(part: pa.Table) -> pa.Table:
    """The sums of one cluster, one row for each task, as one row."""
    total = matrix(part.column("total").combine_chunks()).sum(axis=0)
    return pa.table({"cluster": [part.column("cluster")[0].as_py()], "n": [int(part.column("n").to_numpy().sum())], "total": [total.tolist()]}, schema=pa.schema([("cluster", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))]))


#: Bytes of centres that a task holds at once; more are a table that is gone through in blocks.
BLOCK = 32 << 20


def kmeans(rows: DataFrame, key: str, vector: str, label: str, spherical: bool = True, rounds: int = 200, tol: float = 5e-4) -> DataFrame:
    """(key, cluster): as many clusters as labels, seeded with their means; an empty cluster keeps its centre. Rounds end when centres move by less than tol on average, or no row changes its cluster.

    Only centres travel: each partition sums its rows by cluster, and the sums (clusters x dimensions) meet
    on the driver, whatever the number of rows. Where all centres are more than BLOCK bytes they stay a table.
    """
    scratch = Scratch(rows.sparkSession)
    unit = rows.select(F.col(key).cast("long").alias("id"), (F.transform(vector, lambda x: x.cast("double")) if not spherical else neighbours.S.normalised(F.col(vector))).alias("v"), F.col(label).alias("label"))
    unit = written(unit, "vectors")
    means = unit.select("label", F.posexplode("v").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("c"))
    seeds = scratch.write(ordering.numbered(means, [], ["label"], "cluster").select(F.col("cluster").cast("long").alias("cluster"), "c"), "seeds")
    told = seeds.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("c")), F.lit(0)).alias("bytes")).first()
    if not told["n"]:
        return unit.select(F.col("id").alias(key), F.lit(0).cast("long").alias("cluster"))
    if told["bytes"] > BLOCK:
        return _of_many(unit, seeds, spherical, rounds, tol, scratch).withColumnRenamed("id", key)
    centres = matrix(seeds.orderBy("cluster").select("c").toArrow().column("c").combine_chunks())
    scratch.clear()
    length = lambda c: np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    centres = centres / length(centres) if spherical else centres
    for _ in range(rounds):
        # A task's sums are clusters x dimensions; they are added up by cluster in tasks, and one row of each cluster comes back.
        got = unit.select("id", "v").mapInArrow(_sums(centres, spherical), "cluster long, n long, total array<double>")
        held = got.groupBy("cluster").applyInArrow(_added, "cluster long, n long, total array<double>").toArrow()
        at, n = held.column("cluster").to_numpy(), held.column("n").to_numpy()
        new = centres.copy()
        new[at[n > 0]] = matrix(held.column("total").combine_chunks())[n > 0] / n[n > 0, None]
        new = new / length(new) if spherical else new
        shift = float(np.linalg.norm(new - centres, axis=1).mean())
        centres = new
        if shift <= tol:
            break
    return unit.select("id", "v").mapInArrow(_assign(centres, spherical), "id long, cluster long").withColumnRenamed("id", key)


def _nearest_centres(state: DataFrame, centres: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, v, was, cluster): each row's nearest centre, the lowest number of equals, beside the one it had. state: (id, v, cluster); centres: (cluster, c)."""
    spark = state.sparkSession
    mean = centres.select(F.posexplode("c").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x")).orderBy("at").toArrow().column("x").to_numpy()  # one row for each dimension
    pivot = F.array(*[F.lit(float(x)) for x in mean])
    away = F.sqrt(F.aggregate(F.zip_with("c", pivot, lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x))
    each = max(1, BLOCK // (8 * len(mean)))
    placed = scratch.write(ordering.numbered(centres.withColumn("away", away), [], ["away", "cluster"], "place"), "placed")
    now = state.select("id", "v", F.col("cluster").alias("was"), F.lit(-1).cast("long").alias("cluster"), F.lit(float("inf")).alias("d"))
    for block in range(-(-placed.count() // each)):
        held = placed.where(F.floor(F.col("place") / each) == block).orderBy("cluster").toArrow()  # BLOCK bytes
        told = spark.sparkContext.broadcast((mean, held.column("cluster").to_numpy(), matrix(held.column("c").combine_chunks()), held.column("away").to_numpy()))

        def nearer(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            mean, ids, c, away = told.value
            for batch in (b.slice(at, 2_000) for b in batches for at in range(0, b.num_rows, 2_000)):
                x = matrix(batch.column(1)).reshape(batch.num_rows, len(mean))
                cluster, d = batch.column(3).to_numpy().copy(), batch.column(4).to_numpy().copy()
                own = np.linalg.norm(x - mean, axis=1)
                gap = np.maximum(np.maximum(away.min() - own, own - away.max()), 0.0)
                for at in np.array_split(np.flatnonzero(gap <= d + 1e-9), max(1, batch.num_rows * len(ids) // (1 << 22))):
                    if len(at):
                        e = np.maximum((x[at] ** 2).sum(1)[:, None] - 2 * x[at] @ c.T + (c * c).sum(1), 0.0)
                        k = e.argmin(axis=1)
                        near = np.sqrt(e[np.arange(len(at)), k])
                        better = (near < d[at]) | (near == d[at]) & (ids[k] < cluster[at])
                        cluster[at[better]], d[at[better]] = ids[k[better]], near[better]
                yield pa.record_batch([*batch.columns[:3], pa.array(cluster), pa.array(d)], names=["id", "v", "was", "cluster", "d"])

        now = now.mapInArrow(nearer, "id long, v array<double>, was long, cluster long, d double")
        if block % 4 == 3:
            now = scratch.write(now, "nearest")
    return scratch.write(now.drop("d"), "state")


def _cluster_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cluster, v) one row for each cluster of a batch: its count and vector sum."""
    for batch in batches:
        at, which = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        if len(at):
            total = _summed(which, matrix(batch.column(1)), len(at))
            yield pa.record_batch([pa.array(at), pa.array(np.bincount(which)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["cluster", "n", "total"])


def _of_many(unit: DataFrame, centres: DataFrame, spherical: bool, rounds: int, tol: float, scratch: Scratch) -> DataFrame:
    """(id, cluster) where the centres are a table (cluster, c): rows go through its blocks one after the other and keep the nearest centre so far.

    Blocks hold centres of similar distance to one pivot, the mean of all. A row whose own distance to the pivot differs from all of a block's
    by more than its best distance so far can't have its nearest centre there, and isn't compared. Sums by
    cluster are rows: a batch's rows of one cluster are one of them. Each round's tables go when the next one's are written.
    """
    spark = unit.sparkSession
    if spherical:
        centres = centres.withColumn("c", neighbours.S.normalised(F.col("c"), 1e-12, "safe"))
    state, before = unit.select("id", "v", F.lit(-1).cast("long").alias("cluster")), scratch
    for _ in range(rounds):
        own = Scratch(spark)
        state = _nearest_centres(state, centres, own)
        if state.where("was <> cluster").isEmpty():
            before.clear()
            return own.result(state.select("id", "cluster"), "clusters")
        sums = state.select("cluster", "v").mapInArrow(_cluster_sums, "cluster long, n long, total array<double>").groupBy("cluster").applyInArrow(_added, "cluster long, n long, total array<double>")
        moved = sums.select(F.col("cluster").alias("__k"), F.transform("total", lambda x: x / F.col("n")).alias("__c"))
        new = F.coalesce("__c", "c")
        if spherical:
            new = neighbours.S.normalised(new, 1e-12, "safe")
        both = own.write(centres.join(moved, F.col("cluster") == F.col("__k"), "left").select("cluster", F.col("c").alias("old"), new.alias("c")), "centres")
        shift = both.agg(F.avg(F.sqrt(F.aggregate(F.zip_with("old", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))).alias("s")).first()["s"]
        before.clear()
        before, centres = own, both.drop("old")
        if shift <= tol:
            break
    last = Scratch(spark)
    out = last.result(_nearest_centres(state, centres, last).select("id", "cluster"), "clusters")
    before.clear()
    return out


#: Directions that a projection follows besides those asked for, coordinates of a block of sums.
MORE, WIDE = 62, 1024


def _added_blocks(part: pa.Table) -> pa.Table:
    """The sums of one block of coordinates, one row for each task, as one row."""
    total = matrix(part.column("total").combine_chunks()).sum(axis=0)
    return pa.table({"block": [part.column("block")[0].as_py()], "total": [total.tolist()]}, schema=pa.schema([("block", pa.int32()), ("total", pa.list_(pa.float64()))]))


def _scattered(unit: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The scatter matrix of the centred rows times q, which has few columns: each task sums up coordinates x columns, blocks of them are added up in tasks of their own."""
    told = unit.sparkSession.sparkContext.broadcast((mean, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, q = told.value
        total = np.zeros_like(q)
        for batch in (b.slice(at, 2_000) for b in batches for at in range(0, b.num_rows, 2_000)):
            x = matrix(batch.column(0)).reshape(batch.num_rows, len(mean)) - mean
            total += x.T @ (x @ q)
        starts = range(0, len(q), WIDE)
        yield pa.record_batch([pa.array(range(len(starts)), pa.int32()), pa.array([total[k : k + WIDE].ravel().tolist() for k in starts], pa.list_(pa.float64()))], names=["block", "total"])

    held = unit.select("v").mapInArrow(run, "block int, total array<double>").groupBy("block").applyInArrow(_added_blocks, "block int, total array<double>").toArrow()
    parts = dict(zip(held.column("block").to_pylist(), held.column("total").to_pylist(), strict=True))
    return np.concatenate([np.array(parts[k]).reshape(-1, q.shape[1]) for k in sorted(parts)])


def projection(rows: DataFrame, key: str, vector: str, dims: int = 2, iterations: int = 30, tol: float = 1e-9) -> DataFrame:
    """(key, x0..): coordinates along the main axes of the centred unit vectors, by randomised subspace iteration.

    What travels is coordinates x (dims + MORE) sums, never coordinates x coordinates; each round reads the vectors once, and rounds
    end when the axes stand still. Vectors of no more coordinates than that take one round.
    """
    unit = written(rows.select(F.col(key).alias("id"), neighbours.S.normalised(F.col(vector)).alias("v")), "vectors")
    sums = unit.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m")).toArrow()  # one row for each coordinate
    if not sums.num_rows:
        return unit.select(F.col("id").alias(key), *[F.lit(0.0).alias(f"x{k}") for k in range(dims)])
    mean = np.zeros(sums.num_rows)
    mean[sums.column("at").to_numpy()] = sums.column("m").to_numpy()
    width = min(len(mean), dims + MORE)
    q = np.eye(len(mean)) if width == len(mean) else np.linalg.qr(np.random.default_rng(0).normal(size=(len(mean), width)))[0]
    axes = None
    for _ in range(1 if width == len(mean) else iterations):
        y = _scattered(unit, mean, q)
        values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        new = (q @ turn)[:, ::-1][:, :dims]
        new = new * np.sign(new.sum(axis=0) + 1e-12)
        still = axes is not None and float(np.abs(new - axes).max()) < tol
        axes = new
        if still:
            break
        q = np.linalg.qr(y)[0]
    told = unit.sparkSession.sparkContext.broadcast((mean, axes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = told.value
        for batch in batches:
            x = (matrix(batch.column(1)).reshape(batch.num_rows, len(mean)) - mean) @ axes
            yield pa.record_batch([batch.column(0), *[pa.array(x[:, k]) for k in range(axes.shape[1])]], names=["id", *[f"x{k}" for k in range(axes.shape[1])]])

    kind = unit.schema["id"].dataType.simpleString()
    got = unit.mapInArrow(place, f"id {kind}, " + ", ".join(f"x{k} double" for k in range(axes.shape[1])))
    return got.select(F.col("id").alias(key), *[F.col(f"x{k}") if k < axes.shape[1] else F.lit(0.0).alias(f"x{k}") for k in range(dims)])


def scored_subset(clusters: DataFrame, rows: DataFrame, key: str, label: str, subset) -> DataFrame:
    """Agreement of all rows' clusters with the labels of those that the condition picks: clusters of everything, scored on a part."""
    return evaluation.agreement(clusters.join(rows.where(subset).select(key, label), key), label, "cluster")


def evaluated_runs(vectors: DataFrame, plan: DataFrame, runs: list[int], item: str, region: str, vector: str, ranks: list[str], cases: dict, methods: tuple[bool, ...] = (True, False), rounds: int = 200) -> DataFrame:
    """evaluated for each run, with run: a run clusters the items' vectors of the regions that its plan names.

    vectors: (item, region, vector, ranks); plan: (run, item, region). An item without a vector of its region isn't in the run.
    """
    out = None
    for run in runs:
        rows = vectors.join(plan.where(F.col("run") == run).select(item, region), [item, region])
        one = evaluated(rows, item, vector, ranks, cases, methods, rounds).withColumn("run", F.lit(run).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def evaluated(rows: DataFrame, key: str, vector: str, ranks: list[str], cases: dict, methods: tuple[bool, ...] = (True, False), rounds: int = 200) -> DataFrame:
    """(spherical, rank, case, n_rows, homogeneity, completeness, v_measure, adjusted_rand): every method, seeded and judged by every rank, scored on every case.

    cases: name -> condition on the rows that are scored. A case with fewer than two labels has no row.
    """
    out = None
    for spherical in methods:
        for rank in ranks:
            got = written(kmeans(rows, key, vector, rank, spherical, rounds), "clusters")
            for name, subset in cases.items():
                part = got.join(rows.where(subset).select(key, F.col(rank).alias("label")), key)
                size = part.agg(F.count("*").alias("n_rows"), F.count_distinct("label").alias("n_labels"))
                one = evaluation.agreement(part, "label", "cluster").join(F.broadcast(size)).where("n_labels > 1")
                one = one.select(F.lit(spherical).alias("spherical"), F.lit(rank).alias("rank"), F.lit(name).alias("case"), "n_rows", "homogeneity", "completeness", "v_measure", "adjusted_rand")
                out = one if out is None else out.unionByName(one)
    return out
