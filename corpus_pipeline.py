"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs; ``left`` gets the tables that its result still reads. All but the last return the columns
of documents, less the rows that they drop.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import bpe, decontam, exact_dedup, near_dedup, quality
from rankloom.llm.common import Scratch, keep_only

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.3


def _without(docs: DataFrame, dropped: DataFrame, scratch: Scratch, left: Scratch | None) -> DataFrame:
    """docs less the dropped ids. These are written to a table of their own, which ``left`` notes, so that all that led up to them can be removed."""
    ids = (left or Scratch(docs.sparkSession)).write(dropped, "dropped")
    scratch.clear()
    return keep_only(docs, ids, "doc_id")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, left: Scratch | None = None) -> DataFrame:
    """Rows with a score of LEAST_QUALITY or more; null and empty texts have the labelled rows' share of good ones as theirs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(*quality.labelled_sample(docs, labels, "quality", quality.SAMPLE))
    kept = tuple(f"__{k}" for k in range(len(docs.columns)))
    own = dict(zip(docs.columns, kept, strict=True))
    rows = docs.toDF(*kept)
    others = tuple(c for c in kept if c != own["doc_id"])
    return quality.score(rows, model, own["doc_id"], own["text"], others).where(F.col("score") >= LEAST_QUALITY).select(*kept).toDF(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, left: Scratch | None = None) -> DataFrame:
    """Of rows with equal texts (null counts as empty) those with the largest id; rows with a null id stay."""
    scratch = Scratch(spark)
    found = exact_dedup.exact_duplicates(docs, scratch=scratch)
    return _without(docs, found.where(~F.col("kept")).select(F.col("doc_id").cast("long").alias("id")), scratch, left)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, left: Scratch | None = None) -> DataFrame:
    """One document of each component of near-duplicates; texts without words, and rows with a null id, stay."""
    scratch = Scratch(spark)
    found = near_dedup.near_duplicates(docs, width=5, percent=80, scratch=scratch)
    return _without(docs, found.where(~F.col("kept")).select(F.col("doc_id").alias("id")), scratch, left)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, left: Scratch | None = None) -> DataFrame:
    """Rows that aren't contaminated; texts without words aren't."""
    scratch = Scratch(spark)
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch=scratch)
    return _without(docs, found.where("contaminated").select(F.col("doc_id").cast("long").alias("id")), scratch, left)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, left: Scratch | None = None) -> DataFrame:
    """A row of token ids for each row; null and empty texts have none."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe encoding", encoding_stage),
]

#: The quality model and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again, and removed once the next one's are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        left, own = Scratch(spark), Scratch(spark)
        docs = own.write(stage(spark, docs, sf_dir, left), name.replace(" ", "-"))
        left.clear()
        before.clear()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
