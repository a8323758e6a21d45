"""URL filters: host and path rules, and a blocked Bloom filter before an exact hash join for long lists.

A list holds canonical URLs: host in lower case without a leading ``www.``, path without a
trailing slash, no query. An entry whose path is ``/`` lists a whole site, with all
subdomains. A URL is looked up by its canonical form and by every suffix of its host.

A listed URL sets one bit in each of the eight words of one block. The filter is sized
from the counted list, up to MOST blocks (a longer list only lets more keys through), so
it may be broadcast; keys that may be listed go on to a hash join with the list, which
removes the false positives. The list is the build side, in as many parts as there are
shuffle partitions; a hot URL's rows are split there by adaptive execution.

Defined cases: a null URL or one without ``://`` has an empty host and path and is
never listed; ports and user names stay part of the host; a host has at most LABELS
labels, what stands before the last LABELS is no host's; repeated rows and ids are
judged each by themselves; null list entries list nothing; an empty list blocks nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, text_or_empty

#: Blocks of 512 bits of the largest filter, 4 MB, and keys for each block of a smaller one.
MOST, KEYS = 1 << 16, 32
#: Labels of the longest domain name.
LABELS = 127
#: Odd multipliers, one for each word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def split_url(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.regexp_extract(text_or_empty(url), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """value(rule) of the longest rule that fits, else null. Rules are a short configured list."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def _mask(key: Column, k: int) -> Column:
    """The bit of word k: the top six bits of a 32-bit product."""
    at = F.shiftrightunsigned(F.xxhash64(key, F.lit(2)).bitwiseAND(0xFFFFFFFF).bitwiseAND(0x7FFFFFFF) * F.lit(SALTS[k]), 26).bitwiseAND(63)
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def canonical(host: Column, path: Column) -> Column:
    """host without a leading www. and path without a trailing slash; the path of a site is /."""
    bare = F.regexp_replace(path, r"/$", "")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.when(bare == "", "/").otherwise(bare))


def lookups(host: Column, path: Column) -> Column:
    """array<string>: the canonical URL, then host and domains above it as sites; empty without a host."""
    labels = F.split(host, r"\.", -1)
    tail = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - LABELS + 1), F.lit(LABELS))
    sites = F.transform(F.array(tail), lambda t: F.transform(F.sequence(F.lit(1), F.size(t)), lambda k: F.concat(F.array_join(F.slice(t, k, F.lit(LABELS)), "."), F.lit("/"))))[0]
    return F.when(host != "", F.array_distinct(F.concat(F.array(canonical(host, path)), sites))).otherwise(F.array().cast("array<string>"))


def bloom_blocks(listed: DataFrame, key: Column, blocks: int) -> DataFrame:
    """(block, w0..w7): at most ``blocks`` rows."""
    return listed.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")).agg(*[F.bit_or(_mask(key, k)).alias(f"w{k}") for k in range(8)])


def listed_rows(urls: DataFrame, listed: DataFrame, keys: Column, scratch: Scratch, blocks: int | None = None) -> DataFrame:
    """urls with a boolean ``listed``: whether one of the row's keys is exactly in the one column of ``listed``. The result reads a table of ``scratch``."""
    known = listed.toDF("__k").where("__k is not null").distinct()
    if blocks is None:
        blocks = 1
        n = known.count()
        while blocks < MOST and blocks * KEYS < n:
            blocks *= 2
    bloom = bloom_blocks(known, F.col("__k"), blocks).withColumnRenamed("block", "__block")
    each = urls.withColumn("__row", F.monotonically_increasing_id()).select("*", F.posexplode_outer(keys).alias("__at", "__key"))
    probed = each.withColumn("__b", F.pmod(F.xxhash64("__key"), F.lit(blocks))).join(F.broadcast(bloom), F.col("__b") == F.col("__block"), "left")  # MOST rows at most
    hit = F.lit(True)
    for k in range(8):
        hit = hit & (F.col(f"w{k}").bitwiseAND(_mask(F.col("__key"), k)) != 0)
    marked = probed.select(*urls.columns, "__row", "__at", "__key", (F.coalesce(hit, F.lit(False)) & F.col("__key").isNotNull()).alias("__may"))
    # One line for each row, and one for each further key that may be listed.
    lines = scratch.write(marked.where("__may or __at = 0 or __at is null"), "probed")
    sure = lines.where("__may").select("__row", "__key").join(known.hint("shuffle_hash"), F.col("__key") == F.col("__k"), "left_semi").select("__row").distinct()
    hits = scratch.write(sure, "listed").select(F.col("__row").alias("__hit"))
    rows = lines.where("__at = 0 or __at is null").select(*urls.columns, "__row")
    return rows.join(hits, F.col("__row") == F.col("__hit"), "left").select(*urls.columns, F.col("__hit").isNotNull().alias("listed"))


def judge(pages: DataFrame, rules: tuple[Rule, ...], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", scratch: Scratch | None = None) -> DataFrame:
    """One row per row: id_col, host, path, rule (host + path, null where none fits), verdict (the rule's, else block where the list has the URL, else allow)."""
    host, path = split_url(F.col("__url"))
    urls = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).select("__id", host.alias("host"), path.alias("path"))
    judged = listed_rows(urls, listed, lookups(F.col("host"), F.col("path")), scratch or Scratch(pages.sparkSession))
    verdict = F.coalesce(rule_for(F.col("host"), F.col("path"), rules, lambda r: r.verdict), F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(F.col("__id").alias(id_col), "host", "path", rule_for(F.col("host"), F.col("path"), rules, lambda r: r.host + r.path).alias("rule"), verdict.alias("verdict"))
