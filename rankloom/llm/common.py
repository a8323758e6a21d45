"""Small helpers shared by the training-data operators.

Every operator first projects the columns it needs to private names, so extra
columns of the input, whatever they are called, never clash with its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a Python worker keeps from task to task, see kept().
_KEPT: dict = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bits of the membership filter that may be broadcast: 2^22 bits are 65,536 words of 64 bits, about 1 MB.
FILTER_BITS = 1 << 22
#: Rows of a few numbers each that may be broadcast: under 10 MB.
FEW = 200_000


def text_or_empty(col: str | Column) -> Column:
    """The column as a string, null read as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where none is set, a local session (as in tests) gets a temporary one; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rankloom-checkpoint-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


class Scratch:
    """Tables written to the shared folder, each removed once nothing reads it any more.

    Reading a written table cuts the lineage: a lost executor then costs the tasks that
    ran on it, not what led up to them. A table may be dropped when all that was read
    from it has itself been written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path, compression=compression)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove the tables written under these names so far."""
        jvm = self.spark._jvm
        for name in names:
            for path in self.paths.pop(name, []):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def clear(self) -> None:
        self.drop(*list(self.paths))
        self.settle()

    def settle(self) -> None:
        """Let Spark's cleaner remove the shuffle files of DataFrames that are gone."""
        gc.collect()
        self.spark._jvm.System.gc()


def kept(key: object, make: Callable[[], object]) -> object:
    """What make() gives, kept by a Python worker from task to task while they ask for the same key.

    Another key's goes first: workers serve one operator after the other, and would else hold the tables of all of them.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def among_least(df: DataFrame, key: str, sample: int) -> DataFrame:
    """df, less most rows whose hash of the key is not among the ``sample`` smallest.

    Twice the share of hashes that is wanted is let through, so that sorting for the
    smallest ones moves a few rows of each task; where that is too few, all rows are.
    Counting reads the key only.
    """
    n = df.count()
    if n <= 4 * sample:
        return df
    near = df.where(F.xxhash64(key) <= F.lit(2 * sample * (1 << 64) // n - (1 << 63)))
    return near if near.count() >= sample else df


def filter_words(keys: DataFrame, key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap over hashed keys as rows (w, m) of 64-bit words: at most bits / 64 rows, whatever the input."""
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    return (
        keys.select(h.alias("h"))
        .groupBy(F.shiftright("h", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("m"))
    )


def _bitmap(df: DataFrame, key: Column, words: DataFrame, bits: int) -> tuple[DataFrame, Column, Column]:
    """The bitmap to broadcast, under names that df doesn't have, the join's condition, and whether the key's bit is set in the word met."""
    w, m = "__w", "__m"
    while {w, m} & set(df.columns):
        w, m = w + "_", m + "_"
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    bit = F.call_function("shiftright", F.col(m), h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return F.broadcast(words.select(F.col("w").alias(w), F.col("m").alias(m))), F.shiftright(h, 6).cast("int") == F.col(w), bit


def maybe_in(df: DataFrame, key: Column, words: DataFrame, bits: int = FILTER_BITS, anti: bool = False) -> DataFrame:
    """Rows of df whose key may be in the bitmap (anti: surely is not); the broadcast side has at most bits / 64 rows."""
    words, on, bit = _bitmap(df, key, words, bits)
    return df.join(words, on & bit, "left_anti" if anti else "left_semi")


def marked(df: DataFrame, key: Column, words: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """df with a boolean column: whether the key may be in the bitmap."""
    words, on, bit = _bitmap(df, key, words, bits)
    return df.join(words, on, "left").select(*[df[c] for c in df.columns], F.coalesce(bit, F.lit(False)).alias(name))


def if_few(df: DataFrame, n: int | None = None) -> DataFrame:
    """df to be broadcast if its counted rows, of a few numbers each, are at most FEW; else as it is."""
    return F.broadcast(df) if (df.count() if n is None else n) <= FEW else df


def those_in(df: DataFrame, key: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of df whose key is in the one column of ids (distinct values).

    Few ids are broadcast. While the bitmap of more is sparse it is the first filter and only what it lets through
    is shuffled; where the counted ids would crowd it, all rows meet the ids in a shuffle.
    """
    name, n = ids.columns[0], ids.count()
    if FEW < n <= bits // 8:
        df = maybe_in(df, F.col(key), filter_words(ids, F.col(name), bits), bits)
    ids = ids.select(F.col(name).alias("__in"))
    return df.join(if_few(ids, n), df[key] == ids["__in"], "left_semi")


def keep_only(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in dropped (one long column ``id``), columns unchanged.

    The bitmap lets rows that are surely kept pass without a shuffle; the others
    are checked exactly by an anti-join. Rows with a null id are kept, and so are all
    rows of ids that aren't whole numbers; every row of a dropped id goes.
    """
    words = filter_words(dropped, F.col("id"))
    key = F.coalesce(docs[id_col].try_cast("long"), F.lit(-1))
    sure = maybe_in(docs, key, words, anti=True)
    doubtful = maybe_in(docs, key, words)
    ids = dropped.select(F.col("id").alias("__id"))
    checked = doubtful.join(ids, doubtful[id_col].try_cast("long") == ids["__id"], "left_anti")
    return sure.unionByName(checked)
