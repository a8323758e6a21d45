"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first scan counts the pairs (length, hash of a prefix): the counts of a length are
sums of these, so lengths and prefixes are refined together, and what is shuffled is
partial counts. The second scan hashes whole texts where their pair occurs more than
once, and nothing else: a fixed-size bitmap of those pairs travels to it, so no text is
shuffled. It writes ids and hashes to the shared folder. Groups are then counted from
these, and joined back to rows that both lie in written tables, which is what lets
adaptive execution split a hot group's rows.

Defined cases: a null text counts as empty, empty texts are equal to each
other; of equal texts the row with the largest id stays (null ids are smallest);
a row that repeats another's id and text is the same document twice, both carry
the same decision and both count in group_size; an empty table gives no rows;
other columns are passed through only when ``carry`` names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filter_words, marked, text_or_empty

#: Characters of the prefix that level two hashes.
PREFIX = 256


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix: int = PREFIX, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept and the carried columns. The result reads tables of ``scratch``."""
    scratch = scratch or Scratch(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("__id"),
        text.alias("__text"),
        F.octet_length(text).alias("__n"),
        F.xxhash64(F.substring(text, 1, prefix)).alias("__p"),
        *[F.col(c).alias(f"__c_{c}") for c in carry],
    )
    lengths = rows.groupBy("__n", "__p").agg(F.count("*").alias("c"))
    key = F.xxhash64("__n", "__p")
    shared = filter_words(lengths.where("c > 1"), key)
    carried = [f"__c_{c}" for c in carry]
    # A pair that isn't shared stands for one text, so its hash stays null; a false hit of the bitmap is hashed and found alone.
    full = F.when(F.col("__may"), F.sha2("__text", 256))
    hashed = scratch.write(marked(rows, key, shared, "__may").select("__id", *carried, full.alias("__full")), "hashed")
    groups = hashed.where("__full is not null").groupBy("__full").agg(F.max("__id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = scratch.write(groups, "groups").withColumnRenamed("__full", "__group")
    found = hashed.where("__full is not null").join(groups, F.col("__full") == F.col("__group"), "left")
    grouped = found.select("__id", *carried, F.when(F.col("__group").isNotNull(), F.col("keep_id")).otherwise(F.col("__id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    single = hashed.where("__full is null").select("__id", *carried, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return grouped.unionByName(single).select(
        F.col("__id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *[F.col(f"__c_{c}").alias(c) for c in carry],
    )
