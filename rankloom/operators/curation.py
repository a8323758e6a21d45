"""Curation of a sequence table (ord, header or id, seq, path columns) and samples of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.shared import written
from . import ordering

#: Rows of a group up to which Spark cuts a ranking off in each task before the shuffle.
RANKED = 1_000


def members(rows: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    return rows.join(leaves.select(key).distinct(), key, "left_semi")


def unmatched(rows: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    return leaves.select(key).distinct().join(rows.select(key), key, "left_anti")


def required_leaves(rows: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """rows, all of which must have a leaf: otherwise an error that names up to 20 of the missing."""
    missing = unmatched(leaves, rows, key).orderBy(key).limit(20).agg(F.count("*").alias("__n"), F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ", ").alias("__names"))
    ok = F.when(F.col("__n") > 0, F.raise_error(F.concat(F.lit("no leaf: "), "__names"))).otherwise(True)
    return rows.join(F.broadcast(missing)).where(ok).drop("__n", "__names")


def filter_counts(rows: DataFrame, domain: str, filters: dict[str, Column]) -> DataFrame:
    """(domain, n_rows, one count for each filter): how many rows each filter alone would remove, overall ('All') and by domain."""
    counts = [F.count("*").alias("n_rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in filters.items()]]
    return rows.rollup(F.col(domain).alias("domain")).agg(*counts).withColumn("domain", F.coalesce("domain", F.lit("All")))


def resolved(rows: DataFrame, path: str, least: int = 6) -> DataFrame:
    return rows.where(F.size(path) >= least)


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. Keys are grouped by length and digest, so long ones aren't shuffled, and the least order is aggregated in parts, so a hot key is no hot task."""
    first = rows.groupBy(F.length(key).alias("__n"), F.sha2(F.col(key).cast("string"), 256).alias("__h")).agg(F.min(order).alias(order))
    return rows.join(first.select(order), order, "left_semi")


def length_between(rows: DataFrame, seq: str, low: int, high: int) -> DataFrame:
    return rows.where(F.length(seq).between(low, high))


def most_per_taxon(rows: DataFrame, prefixes: list[list[str]], cap: int, key: Column, seed: int = 0, literal: bool = True) -> DataFrame:
    """At most ``cap`` rows for each taxon, by hash; literal: the first rank alone decides, else each rank in turn.

    Up to RANKED rows of a taxon are kept apart in each task before they meet; of more, places come from range partitions.
    """
    for cols in prefixes[:1] if literal else prefixes:
        if cap <= RANKED:
            w = Window.partitionBy(*cols).orderBy(S.hashed(key, seed), key)
            rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")
        else:
            placed = ordering.numbered(rows.withColumn("__h", S.hashed(key, seed)).withColumn("__k", key), cols, ["__h", "__k"])
            rows = placed.where(F.col("__place") < cap).select(*rows.columns)
    return rows


def least_per_taxon(rows: DataFrame, prefixes: list[list[str]], least: int, literal: bool = True) -> DataFrame:
    """Rows of taxa with enough members; sizes are aggregated before they are joined back."""
    for cols in prefixes[:1] if literal else prefixes:
        sizes = rows.groupBy(*cols).agg(F.count("*").alias("__c")).where(F.col("__c") >= least).drop("__c")
        rows = rows.join(sizes, cols, "left_semi")
    return rows


def first_per_genome(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= most).drop("__n")


def added_back(kept: DataFrame, rows: DataFrame, header: str, ids: list[str], key: str) -> DataFrame:
    """kept with the rows whose header names one of the ids."""
    wanted = rows.where(F.col(header).rlike("|".join(f"\\Q{i}\\E" for i in ids))) if ids else rows.limit(0)
    return kept.unionByName(wanted.join(kept.select(key), key, "left_anti"))


def top_taxa(train: DataFrame, rank: str, order: str, n: int) -> DataFrame:
    """The n taxa with most training rows; ties by first seen."""
    return train.groupBy(rank).agg(F.count("*").alias("n_rows"), F.min(order).alias("first_seen")).orderBy(F.desc("n_rows"), "first_seen").limit(n)


def within_taxa(rows: DataFrame, taxa: DataFrame, rank: str) -> DataFrame:
    """Rows of any split whose taxon is among those, as top_taxa gives them: at most a stated number, so they are broadcast."""
    return rows.join(F.broadcast(taxa.select(rank)), rank, "left_semi")


def hash_rank(key: Column, seed: int) -> tuple[Column, Column]:
    return S.hashed(key, seed), key


def first_by_hash(rows: DataFrame, key: str, n: int, seed: int = 0, inside: tuple[str, ...] = ()) -> DataFrame:
    """Exactly n rows (of each stratum) by hash; places are counted over partitions of the hash order, so no task takes them all."""
    return _by_hash(rows, key, seed, inside).where(F.col("__place") < n).drop("__place", "__size", "__h")


def share_by_hash(rows: DataFrame, key: str, share: float, seed: int = 0, inside: tuple[str, ...] = (), down: bool = False) -> DataFrame:
    """round(share * n) rows of each stratum, or the whole number below it."""
    most = F.col("__size") * share
    return _by_hash(rows, key, seed, inside).where(F.col("__place") < (F.floor(most) if down else F.round(most))).drop("__place", "__size", "__h")


def _by_hash(rows: DataFrame, key: str, seed: int, inside: tuple[str, ...]) -> DataFrame:
    return ordering.numbered(rows.withColumn("__h", S.hashed(F.col(key), seed)), list(inside), ["__h", key], "__place", "__size")


def excluded_taxa(rows: DataFrame, rank: str, low: int, high: int, n: int | None = None) -> DataFrame:
    """n taxa of a size, in the order of their names' hashes, all of them without n; an error where there are fewer than n."""
    found = rows.groupBy(rank).agg(F.count("*").alias("n_rows")).where(F.col("n_rows").between(low, high)).orderBy(F.sha2(F.col(rank).cast("string"), 256), rank)
    if n is None:
        return found
    found = found.limit(n)
    had = found.agg(F.count("*").alias("__had"))
    enough = F.when(F.col("__had") < n, F.raise_error(F.concat(F.lit(f"fewer than {n} taxa of that size: "), F.col("__had").cast("string")))).otherwise(True)
    return had.where(enough).join(F.broadcast(found)).drop("__had")


def length_stats(rows: DataFrame, seq: str, group: str) -> DataFrame:
    """min, max, mean, median, sample std and percentiles of the lengths, over all rows and by group; all of it from counted lengths."""
    sizes = rows.groupBy(group, F.length(seq).alias("__len")).agg(F.count("*").alias("__w"))
    total, mean = F.sum("__w"), F.sum(F.col("__len") * F.col("__w")) / F.sum("__w")
    spread = (F.sum(F.col("__len") * F.col("__len") * F.col("__w")) - total * mean * mean) / (total - 1)
    stats = [
        total.alias("n_rows"), F.min("__len").cast("long").alias("shortest"), F.max("__len").cast("long").alias("longest"), F.round(mean, 6).alias("mean"),
        F.round(F.when(total > 1, F.sqrt(F.greatest(F.lit(0.0), spread))), 6).alias("std"),
    ]
    points = {"p1": 0.01, "p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99}
    named = F.when(F.col("__all"), F.lit("All")).otherwise(F.coalesce(F.col(group).cast("string"), F.lit("All")))
    both = sizes.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("__all"), group, "__len", "__w")
    counted = written(both.groupBy("__all", named.alias(group), "__len").agg(F.sum("__w").alias("__w")), "lengths")
    return ordering.weighted_quantiles(counted, ["__all", group], "__len", "__w", points, stats).drop("__all")


def funnel(rows: DataFrame, steps: list[tuple[str, Column]], group: str | None = None) -> DataFrame:
    """(group, step, name, removed, remaining, percent): how many rows each condition in turn removes, overall ('All') and by group; one pass over the rows.

    percent: of the rows that reached the step. What is summed up is one row for each group and step.
    """
    stage = F.lit(len(steps))
    for k in range(len(steps) - 1, -1, -1):
        stage = F.when(~steps[k][1], k).otherwise(stage)
    groups = F.array(F.lit("All")) if group is None else F.array(F.lit("All"), F.coalesce(F.col(group).cast("string"), F.lit("")))
    each = rows.select(stage.alias("s"), F.explode(groups).alias("group"))
    counted = [x for k in range(len(steps)) for x in (F.count_if(F.col("s") == k).alias(f"r{k}"), F.count_if(F.col("s") > k).alias(f"m{k}"))]
    wide = each.groupBy("group").agg(F.count("*").alias("n"), *counted)
    lines = F.array(*[F.struct(F.lit(k).cast("long").alias("step"), F.lit(name).alias("name"), F.col(f"r{k}").alias("removed"), F.col(f"m{k}").alias("remaining")) for k, (name, _) in enumerate(steps)])
    out = wide.select("group", F.explode(lines).alias("x")).select("group", "x.*")
    return out.withColumn("percent", F.round(F.try_divide(100 * F.col("removed"), F.col("removed") + F.col("remaining")), 6))


def duplicate_depth(rows: DataFrame, seq: str, ranks: list[str], genome: str | None = None) -> DataFrame:
    """For each repeated sequence the deepest level its rows share, counted: (rank, n_sequences, n_extra, longest).

    A genome column is a level below the ranks. Sequences meet by length and SHA-256, so none of them is moved.
    """
    levels = [*ranks, *([genome] if genome else [])]
    keyed = rows.select(F.length(seq).alias("__len"), F.unhex(F.sha2(F.col(seq), 256)).alias("__sha"), *levels)
    agg = keyed.groupBy("__len", "__sha").agg(F.count("*").alias("c"), *[(F.min(r).eqNullSafe(F.max(r))).alias(r) for r in levels]).where("c > 1")
    depth = F.lit("none")
    for r in levels:
        depth = F.when(F.col(r), r).otherwise(depth)
    return agg.groupBy(depth.alias("rank")).agg(F.count("*").alias("n_sequences"), F.sum(F.col("c") - 1).alias("n_extra"), F.max("__len").cast("long").alias("longest"))
