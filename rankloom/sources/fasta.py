"""Sources and sinks: FASTA, index files, all-string CSV, region maps, upserted caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ordering
from ..plans.shared import work_folder  # noqa: F401


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, header, seq) of one or many files; sequences may be folded. A record is one line of the scan, split at the next >.

    ``ord`` orders records as they stand in their file; it isn't dense.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))
    text = F.regexp_replace("value", r"^>", "")
    return raw.where(F.trim("value") != "").select(
        "file", "ord", F.regexp_replace(F.substring_index(text, "\n", 1), r"\r$", "").alias("header"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"\s", "").alias("seq")
    )


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, header): only the lines that begin with >, so no sequence goes past the scan."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))
    return lines.where(F.col("value").startswith(">")).select("file", "ord", F.regexp_replace(F.substring("value", F.lit(2), F.length("value")), r"\r$", "").alias("header"))


def consecutive(headers: DataFrame, folder: bool = False) -> DataFrame:
    """headers with idx, the number in {}; an error unless these are 1, 2, 3 ... in the order of each file, or of all files of a folder by name."""
    told = headers.withColumn("idx", S.header_index(F.col("header")))
    placed = ordering.numbered(told, [], ["file", "ord"]) if folder else ordering.numbered(told, ["file"], ["ord"])
    right = F.col("idx").eqNullSafe(F.col("__place") + 1)
    checked = F.when(~right, F.raise_error(F.concat(F.lit("index out of order: "), "header")).cast("long")).otherwise(F.col("idx"))
    return placed.withColumn("idx", checked).drop("__place")


def read_regions(spark: SparkSession, folder: str, use_full: bool = True) -> DataFrame:
    """All {REGION}_seqs.fasta of a folder in one scan with a region_id; failed files don't count."""
    rows = read_fasta(spark, f"{folder}/*_seqs.fasta").withColumn("region_id", F.regexp_extract("file", r"([^/]+)_seqs\.fasta(?:/[^/]*)?$", 1))
    rows = rows.where(~F.col("region_id").startswith("failed"))
    return rows if use_full else rows.where("region_id <> 'FULL'")


def validated(records: DataFrame, trim: int = 0, least: int = 40, ambiguous: bool = False, drop: bool = False) -> DataFrame:
    """Trimmed sequences; a short one or, unless allowed, a letter outside ACGT is an error, or is left out if dropping is asked for."""
    seq = S.trimmed(F.upper("seq"), trim) if trim else F.upper("seq")
    bad = (F.length("s") < least) | (F.lit(False) if ambiguous else ~F.col("s").rlike("^[ACGT]*$"))
    if drop:
        return records.withColumn("s", seq).where(~bad).withColumn("seq", F.col("s")).drop("s")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid sequence: "), "header"))).otherwise(F.col("s"))
    return records.withColumn("s", seq).withColumn("seq", checked).drop("s")


def read_indices(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct integers, one to a line; empty files are allowed."""
    return spark.read.text(list(paths)).where(F.trim("value") != "").select(F.trim("value").cast("long").alias("id")).distinct()


def read_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV of strings in which empty cells are empty texts, so that they differ from rows that a join doesn't find."""
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_region_map(spark: SparkSession, path: str) -> DataFrame:
    """(region_idx, region_id) of {"region_indices": {"0": "FULL", ...}}."""
    held = F.from_json("value", "struct<region_indices: map<string, string>>")
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(held["region_indices"]).alias("k", "region_id")).select(F.col("k").cast("int").alias("region_idx"), "region_id")
    twice = rows.groupBy("region_id").agg(F.count("*").alias("n"))  # a map of a few regions
    once = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("region id used twice: "), "region_id"))).otherwise(F.col("region_id"))
    return rows.join(F.broadcast(twice), "region_id").select("region_idx", once.alias("region_id"))


def write_fasta(records: DataFrame, path: str, order: str | None = None) -> None:
    """One line for a header and one for its sequence, sorted by genome id unless another column is named."""
    key = F.col(order) if order else S.genome_id(F.col("header"))
    records.orderBy(key, "header").select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value")).write.text(path)


def benchmark_records(records: DataFrame, item: str = "idx", region: str = "region_id") -> DataFrame:
    """(header, seq): headers rewritten to {item_REGION} before what they said."""
    told = F.concat(F.lit("{"), F.col(item).cast("string"), F.lit("_"), F.col(region), F.lit("}"), F.regexp_replace("header", r"^\{[^}]*\}", ""))
    return records.select(told.alias("header"), "seq")


def true_classes(records: DataFrame, item: str, region: str, path, ranks: int = len(S.RANKS)) -> DataFrame:
    """ASV_ID, Seq_Index, Region_Train (NA), Region_Test and one column for each rank, all strings."""
    pad = S.padded_path(path, ranks)
    names = [r.capitalize() for r in S.RANKS[:ranks]]
    asv = F.concat(F.col(item).cast("string"), F.lit("_"), region)
    return records.select(asv.alias("ASV_ID"), F.col(item).cast("string").alias("Seq_Index"), F.lit("NA").alias("Region_Train"), F.col(region).alias("Region_Test"), *[F.get(pad, F.lit(k)).alias(n) for k, n in enumerate(names)])


def write_table(df: DataFrame, path: str, sep: str = ",", digits: int = 6, append: bool = False) -> None:
    """A table of delimited text with a header, floating point numbers with a stated number of digits; a folder that exists is an error unless appended to."""
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*[F.when(F.col(c).isNotNull(), e).alias(c) for c, e in zip(df.columns, cols, strict=True)]).write.mode("append" if append else "errorifexists").csv(path, header=True, sep=sep)


def write_json(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """A snapshot as lines of JSON, nulls written out; it takes the place of an earlier one."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_misclassified(rows: DataFrame, path: str, rank: str, key: str) -> None:
    """sequence_index, true_taxon, predicted_taxon of the rows whose true_<rank> and pred_<rank> differ, a folder for the rank: each part file begins with the header, and counts/ says total_num_seqs=N."""
    folder = f"{path}/{rank}"
    rows.agg(F.count("*").alias("n")).select(F.concat(F.lit("total_num_seqs="), F.col("n").cast("string")).alias("value")).write.text(f"{folder}/counts")
    wrong = rows.where(~F.col(f"true_{rank}").eqNullSafe(F.col(f"pred_{rank}")))
    write_table(wrong.select(F.col(key).alias("sequence_index"), F.col(f"true_{rank}").alias("true_taxon"), F.col(f"pred_{rank}").alias("predicted_taxon")), f"{folder}/rows")


def read_misclassified(spark: SparkSession, path: str, rank: str) -> DataFrame:
    """(rank, sequence_index, true_taxon, predicted_taxon, total_num_seqs) as write_misclassified wrote them, all but the count as strings."""
    total = spark.read.text(f"{path}/{rank}/counts").select(F.substring_index("value", "=", -1).cast("long").alias("total_num_seqs"))  # one row
    return read_strings(spark, f"{path}/{rank}/rows").select(F.lit(rank).alias("rank"), "*").join(F.broadcast(total))


def read_scores(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value) of a tab-separated cache of results; a value that is no number is null."""
    rows = read_strings(spark, path, "\t")
    return rows.select(key, F.col(value).try_cast("double").alias(value))


def write_indices(ids: DataFrame, path: str) -> None:
    """One integer to a line; a file that exists is an error."""
    ids.select(F.col(ids.columns[0]).cast("string").alias("value")).write.mode("errorifexists").text(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new one where a key is in both."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.col("__v").desc())
    return both.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__v", "__n")
