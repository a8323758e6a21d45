"""Tables in the folder that driver and executors share; reading one cuts the lineage of what led up to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where none is set, a local session (as in tests) gets a temporary one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Written tables that can be removed: ``result`` writes what was asked for and removes all that led up to it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = work_folder(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        self.clear()
        return out


def written(df: DataFrame, name: str) -> DataFrame:
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Pairs that one task makes, and queries that are broadcast at once.
PAIRS, QUERIES = 1 << 24, 20_000


def over_tasks(rows: DataFrame, queries: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """rows in ranges of an order, over as many tasks as their pairs with the queries are work for, and the queries in blocks of about QUERIES rows by a key."""
    m = queries.count()
    n = max(1, -(-m // QUERIES))
    blocks = [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]
    return rows.repartitionByRange(max(1, -(-rows.count() * m // (n * PAIRS))), *order), blocks
