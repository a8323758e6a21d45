"""A stream's running hardness: the moving average of a value by key, one update for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def moving_averages(events: DataFrame, key: str, value: str, path: str, checkpoint: str, alpha: float = 0.05, once: bool = False) -> StreamingQuery:
    """Starts a query that keeps (key, ema, batch) under ``path``, a folder for each batch; a batch that is run again writes the same folder.

    once: take what is there in as many batches as it needs, then stop.
    """
    spark = events.sparkSession

    def update(batch: DataFrame, number: int) -> None:
        seen = batch.groupBy(key).agg(F.avg(value).alias("seen"))
        if number:
            state = spark.read.parquet(f"{path}/batch={number - 1}")
            both = state.join(seen, key, "full").select(key, F.when(F.col("ema").isNull(), F.col("seen")).when(F.col("seen").isNull(), F.col("ema")).otherwise((1 - alpha) * F.col("ema") + alpha * F.col("seen")).alias("ema"))
        else:
            both = seen.withColumnRenamed("seen", "ema")
        both.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = events.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def newest(spark, path: str) -> DataFrame:
    """(key, ema, batch) as the last batch left it."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch").alias("__b"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("__b")).drop("__b")


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, key, n_events) by tumbling windows; events later than ``late`` are not waited for."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("start"), key, "n_events")
