"""Mining over many batches: mined runs are kept as tables, each batch takes the next rows of the newest one, and every batch leaves a version of the state.

A folder holds ``run=b`` for each batch b at which was mined (pairs, triplets, and the hardness of both after it), and
``state/batch=b``: from which run batch b takes its rows, and from which place on. The state of a batch is
written last. A job that was stopped goes on behind the last batch that has its state, and
writes what it had begun anew; the same inputs give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mining

STATE = "batch long, run long, pairs_from long, triplets_from long, n_pairs long, n_triplets long"


def _complete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def state(spark: SparkSession, folder: str, batch: int):
    """The state row of a batch, None where the batch isn't complete."""
    path = f"{folder}/state/batch={batch}"
    return spark.read.schema(STATE).parquet(path).first() if _complete(spark, path) else None


def last_complete(spark: SparkSession, folder: str, upto: int) -> int:
    """The last batch, up to one, before which all are complete; 0 where there is none."""
    done = 0
    while done < upto and _complete(spark, f"{folder}/state/batch={done + 1}"):
        done += 1
    return done


def _rows(spark: SparkSession, folder: str, run: int, kind: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/run={run}/{kind}")


def run_batches(rows: DataFrame, key: str, ranks: list[str], vector: str, folder: str, n_batches: int, sizes: tuple[int, int], ahead: int = 1, **how) -> DataFrame:
    """Mines batches 1 to n_batches; returns their states. sizes: pairs and triplets of a batch; ahead: batches' worth that one run mines; how: as for ``mining.mine_batch``.

    A batch whose pairs or triplets the newest run can't fill any more starts a run of its own, from the
    hardness that the last run left; what was left of that is not used.
    """
    spark = rows.sparkSession
    for batch in range(last_complete(spark, folder, n_batches) + 1, n_batches + 1):
        before = state(spark, folder, batch - 1) if batch > 1 else None
        taken = None
        if before is not None:
            pairs_from, triplets_from = before["pairs_from"] + sizes[0], before["triplets_from"] + sizes[1]
            if before["n_pairs"] - pairs_from >= sizes[0] and before["n_triplets"] - triplets_from >= sizes[1]:
                taken = (before["run"], pairs_from, triplets_from, before["n_pairs"], before["n_triplets"])
        if taken is None:
            states = (None, None) if before is None else tuple(_rows(spark, folder, before["run"], f"hardness_of_{k}") for k in ("pairs", "triplets"))
            pairs, triplets, after = mining.mine_batch(rows, key, ranks, vector, batch, states=states, totals=(sizes[0] * ahead, sizes[1] * ahead), **how)
            tables = {"pairs": pairs, "triplets": triplets, "hardness_of_pairs": after[0], "hardness_of_triplets": after[1]}
            for name, table in tables.items():
                table.write.mode("overwrite").parquet(f"{folder}/run={batch}/{name}")
            n = [_rows(spark, folder, batch, k).count() for k in ("pairs", "triplets")]
            taken = (batch, 0, 0, *n)
        spark.createDataFrame([(batch, *taken)], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch={batch}")
    return spark.read.schema(STATE).parquet(*[f"{folder}/state/batch={b}" for b in range(1, n_batches + 1)]) if n_batches else spark.createDataFrame([], STATE)


def batch_rows(spark: SparkSession, folder: str, batch: int, sizes: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(pairs, triplets) of a complete batch, with their place in it; fewer where a run found fewer than a batch takes."""
    at = state(spark, folder, batch)
    out = []
    for kind, n in zip(("pairs", "triplets"), sizes, strict=True):
        place = F.col("position") - at[f"{kind}_from"]
        out.append(_rows(spark, folder, at["run"], kind).where((place >= 0) & (place < n)).withColumn("place", place).withColumn("batch", F.lit(batch).cast("long")).drop("position"))
    return tuple(out)
