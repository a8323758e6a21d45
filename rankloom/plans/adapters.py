"""The test tables as the inputs the operators expect: the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^acgtACGT]", "")).alias("dna"), "lang", "source")


def tax4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, r0..r3): customers under region, nation, market segment; segments are homonyms under every nation."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    small = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows
    return c.join(F.broadcast(small), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.col("r_name").alias("r0"), F.col("n_name").alias("r1"), F.col("c_mktsegment").alias("r2"), F.col("c_custkey").cast("string").alias("r3")
    )


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"), (F.col("label") % 2).cast("long").alias("r0"), F.col("label").cast("long").alias("r1"), (F.col("vec_id") % 3).alias("r2"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, true, pred, conf, region): a third label order for wrong predictions, some empty."""
    h = F.pmod((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1103515245 + 12345, F.lit(2147483648))
    wrong = F.when(F.col("l_returnflag") == "A", "N").when(F.col("l_returnflag") == "N", "R").otherwise("A")
    pred = F.when(h % 20 == 0, "").when(h % 7 < 2, wrong).otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("true"), pred.alias("pred"), ((h % 101) / 100.0).alias("conf"), F.col("l_linenumber").cast("long").alias("region"), F.col("l_linestatus").alias("status")
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.dayofyear("ts").cast("long").alias("batch"), F.col("event_type").alias("rank"), (F.col("user_id") % 4).alias("bucket"), F.col("value").alias("loss"))


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, rank, true, pred, err): line items as pairs with distances."""
    h = F.pmod((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1103515245 + 12345, F.lit(2147483648))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("j"), (F.col("l_linenumber") - 1).cast("int").alias("rank"), (F.lit(0.2) + F.col("l_discount") * 10).alias("true"), (h % 1601 / 1000.0).alias("pred"))
    return rows.withColumn("err", (F.col("pred") - F.col("true")) * (F.col("pred") - F.col("true")) / (F.col("true") + 0.001))


#: The same, as common table expressions.
SQL = {
    "seqs": "seqs AS (SELECT doc_id, upper(regexp_replace(text, '[^acgtACGT]', '', 'g')) AS dna, lang, source FROM documents)",
    "tax4": "tax4 AS (SELECT c_custkey AS id, r_name AS r0, n_name AS r1, c_mktsegment AS r2, c_custkey::VARCHAR AS r3 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "vecs": "vecs AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, (label % 2)::BIGINT AS r0, label::BIGINT AS r1, vec_id % 3 AS r2 FROM embeddings)",
    "preds": """h AS (SELECT *, ((l_orderkey * 10 + l_linenumber) * 1103515245 + 12345) % 2147483648 AS h FROM lineitem),
preds AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS true_, CASE WHEN h % 20 = 0 THEN '' WHEN h % 7 < 2 THEN CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END ELSE l_returnflag END AS pred,
  (h % 101) / 100.0::DOUBLE AS conf, l_linenumber::BIGINT AS region, l_linestatus AS status FROM h)""",
    "history": "history AS (SELECT event_id, dayofyear(ts) AS batch, event_type AS rank, user_id % 4 AS bucket, value AS loss FROM events)",
    "mined": """m0 AS (SELECT l_orderkey AS i, l_orderkey + l_linenumber AS j, (l_linenumber - 1)::INT AS rank, 0.2::DOUBLE + l_discount * 10 AS true_, ((l_orderkey * 10 + l_linenumber) * 1103515245 + 12345) % 2147483648 % 1601 / 1000.0::DOUBLE AS pred FROM lineitem),
mined AS (SELECT *, (pred - true_) * (pred - true_) / (true_ + 0.001::DOUBLE) AS err FROM m0)""",
}


def sql(names: str, body: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
