"""Regions, panels of taxa, predictions beside the truth, series: small selections that evaluations are run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import curation, ordering


# Regions


def selected_regions(regions: DataFrame, wanted: list[str | int]) -> DataFrame:
    """The regions named by index or id, each once; an unknown name is an error."""
    names = regions.sparkSession.createDataFrame([(str(w),) for w in dict.fromkeys(wanted)], "name string")
    hit = (F.col("name") == F.col("region_id")) | (F.col("name") == F.col("region_idx").cast("string"))
    both = F.broadcast(names).join(regions, hit, "left")  # as many names as the caller wrote
    known = F.when(F.col("region_id").isNull(), F.raise_error(F.concat(F.lit("unknown region: "), "name"))).otherwise(F.col("region_id"))
    return both.select("region_idx", known.alias("region_id")).distinct()


def usable_regions(regions: DataFrame, most: int, selected: DataFrame) -> DataFrame:
    """Selected regions among the first ``most``; the full sequence (0) is none."""
    return regions.where(F.col("region_idx").between(1, most)).join(selected.select("region_idx"), "region_idx", "left_semi")


def region_choice(key: Column, n: int, seed: int = 0) -> Column:
    return S.hashed(key, seed) % n


def other_region(region: Column, key: Column, n: int, seed: int = 1) -> Column:
    """A region other than ``region``, every one alike, without drawing again."""
    return (region + 1 + S.hashed(key, seed) % (n - 1)) % n


# Panels


def largest_panel(rows: DataFrame, outer: str, inner: str, order: str, n: int) -> DataFrame:
    """Rows of the n most frequent inner taxa inside the most frequent outer one."""
    inside = rows.join(F.broadcast(curation.top_taxa(rows, outer, order, 1)), outer, "left_semi")
    return inside.join(F.broadcast(curation.top_taxa(inside, inner, order, n)), inner, "left_semi")  # n rows


def hierarchy(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """One row for each top taxon and its descendants as nested text, parents before brackets, siblings sorted; distinct paths only."""
    level = rows.select(*ranks).distinct().select(*ranks[:-1], F.col(ranks[-1]).alias("tree"))
    for depth in range(len(ranks) - 1, 0, -1):
        level = level.groupBy(*ranks[:depth]).agg(F.array_join(F.sort_array(F.collect_set("tree")), ",").alias("tree"))
        if depth > 1:
            level = level.select(*ranks[: depth - 1], F.concat(ranks[depth - 1], F.lit("("), "tree", F.lit(")")).alias("tree"))
    return level


def length_quantiles(rows: DataFrame, seq: str, by: list[str], points: tuple[float, ...]) -> DataFrame:
    """(by, n_rows, q0, q1, ...): interpolated quantiles of lengths, all from one pass."""
    sizes = rows.select(*by, F.length(seq).alias("__len"))
    return ordering.with_quantiles(sizes, by, "__len", {f"q{k}": p for k, p in enumerate(points)}, [F.count("*").alias("n_rows")])


def repeated_share(rows: DataFrame, taxon: str) -> DataFrame:
    """(n_taxa, n_repeated, percent): taxa (or whole texts) with more than one row. They meet by length and SHA-256, so no text is moved."""
    text = F.col(taxon).cast("string")
    sizes = rows.groupBy(F.length(text).alias("n"), F.unhex(F.sha2(text, 256)).alias("sha")).agg(F.count("*").alias("c"))
    return sizes.agg(F.count("*").alias("n_taxa"), F.count_if(F.col("c") > 1).alias("n_repeated"), F.round(F.avg((F.col("c") > 1).cast("double")) * 100, 6).alias("percent"))


# Predictions


def beside_truth(true: DataFrame, methods: dict[str, DataFrame], key: str) -> DataFrame:
    """true with each method's prediction as pred_<name>; null where the method has no row, '' where it said nothing."""
    for name, rows in methods.items():
        true = true.join(rows.select(key, F.col("pred").alias(f"pred_{name}")), key, "left")
    return true


def seen_scores(rows: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, n_wrong, accuracy, macro): over rows whose label the training rows have; macro weighs labels alike."""
    known = rows.join(seen.select(F.col("label").alias("true")).distinct(), "true", "left_semi")
    each = known.groupBy(*by, "true").agg(F.count("*").alias("n"), F.count_if(F.col("true").eqNullSafe(F.col("pred"))).alias("hit"))
    return each.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("n") - F.col("hit")).alias("n_wrong"), F.round(F.sum("hit") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("macro")
    )


def frequent_taxa(rows: DataFrame, taxon: str, n: int) -> DataFrame:
    hit = F.count_if(F.col("true").eqNullSafe(F.col("pred")))
    return rows.groupBy(taxon).agg(F.count("*").alias("n_rows"), F.round(hit / F.count("*"), 6).alias("accuracy")).orderBy(F.desc("n_rows"), taxon).limit(n)


# Series, counts and codes


def best_of_series(history: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """(series, best, baseline): the largest value and the first that isn't null."""
    return history.groupBy(series).agg(F.max(value).alias("best"), F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("baseline"))


def scaled_counts(counts: DataFrame, domain: str, count: str, kept: DataFrame) -> DataFrame:
    """Counts times the share of their own domain that a subsample (domain, share) kept; a domain it lacks has none."""
    return counts.join(kept, domain, "left").withColumn("scaled", F.col(count) * F.coalesce("share", F.lit(0.0))).drop("share")


def local_codes(rows: DataFrame, label: str, unknown: int = -1) -> DataFrame:
    """rows with code: the place of the label among the sorted ones; missing labels get ``unknown``."""
    codes = ordering.numbered(rows.where(F.col(label) != "").select(label).distinct(), [], [label], "code")
    return rows.join(codes, label, "left").withColumn("code", F.coalesce("code", F.lit(unknown)))


def skipped_runs(rows: DataFrame, by: list[str], label: str, least: int = 2) -> DataFrame:
    """Runs that can't be scored, with how many labels they have."""
    return rows.groupBy(*by).agg(F.countDistinct(label).alias("n_labels")).where(F.col("n_labels") < least)


def inside(pairs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Pairs with both ends among the keys."""
    for end in ("i", "j"):
        pairs = pairs.join(keys.select(F.col(key).alias(end)), end, "left_semi")
    return pairs


def enough_regions(pool: DataFrame, least: int) -> DataFrame:
    """The pool; fewer regions than asked for are an error."""
    n = pool.agg(F.count_distinct("region_idx").alias("__n"))
    ok = F.when(F.col("__n") < least, F.raise_error(F.concat(F.lit("too few regions: "), F.col("__n").cast("string")))).otherwise(True)
    return pool.join(F.broadcast(n)).where(ok).drop("__n")


def capped(rows: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows by hash, in no other order than they had."""
    return curation.first_by_hash(rows, key, most, seed)


def some_regions(records: DataFrame, item: str, region: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` random regions of each item that it has a record in; one for training rows. An item's records are few."""
    w = Window.partitionBy(item).orderBy(S.hashed(F.col(item) * 131 + F.col(region), seed), region)
    return records.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def run_regions(runs: DataFrame, regions: list[int], seed: int = 0) -> DataFrame:
    """runs (run) with one region each that all its rows share: the regions in one hash order, none again before all have been."""
    order = sorted(regions, key=lambda r: ((r * 1103515245 + 12345 + seed) % 2147483648, r))
    return runs.withColumn("region", F.get(F.array(*[F.lit(r).cast("long") for r in order]), (F.col("run") % len(order)).cast("int")))


def panel_rows(rows: DataFrame, key: str, rank: str, taxon: str, n: int, seed: int = 0) -> DataFrame:
    """n random rows of one taxon."""
    return curation.first_by_hash(rows.where(F.col(rank) == taxon), key, n, seed)


def with_features(rows: DataFrame, features: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """rows with a region each and the feature that this region has of them. features: (region, key, feature)."""
    return rows.withColumn("region", region_choice(F.col(key), n, seed)).join(features, ["region", key])


def run_specs(panels: DataFrame, representations: list[str], ks: list[int]) -> DataFrame:
    """One row for each panel, representation and number of clusters."""
    spec = F.array(*[F.struct(F.lit(r).alias("representation"), F.lit(k).alias("k")) for r in representations for k in ks])
    return panels.select("*", F.explode(spec).alias("__s")).select(*panels.columns, "__s.representation", "__s.k")


def split_checks(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """(check, n_bad): rows in no split, rows in several, and split ids that no row has. splits: (key, split)."""
    n = splits.groupBy(key).agg(F.count_distinct("split").alias("n"))
    none = rows.join(n, key, "left_anti").agg(F.count("*").alias("n_bad")).select(F.lit("uncovered").alias("check"), "n_bad")
    several = n.where("n > 1").agg(F.count("*").alias("n_bad")).select(F.lit("overlapping").alias("check"), "n_bad")
    unknown = n.join(rows, key, "left_anti").agg(F.count("*").alias("n_bad")).select(F.lit("unknown").alias("check"), "n_bad")
    return none.unionByName(several).unionByName(unknown)


def leading_masks(records: DataFrame, codes: str, by: list[str]) -> DataFrame:
    """(by, n_rows, n_masked, shortest, longest): sequences that begin with a pad, and whether all have one length."""
    size = F.size(codes)
    return records.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.get(codes, F.lit(0)) == 4).alias("n_masked"), F.min(size).cast("long").alias("shortest"), F.max(size).cast("long").alias("longest"))


def missing_of(wanted: list[int], held: DataFrame, column: str) -> DataFrame:
    """Wanted numbers (the k of k-mer tables, say) that the table lacks."""
    return held.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(wanted)], f"{column} long").join(held.select(F.col(column).cast("long").alias(column)), column, "left_anti")


def require_all(wanted: list[int], held: DataFrame, column: str) -> DataFrame:
    """held; reading it is an error that names the wanted numbers which it lacks."""
    lost = missing_of(wanted, held.select(column).distinct(), column).agg(F.count("*").alias("__n"), F.array_join(F.sort_array(F.collect_list(column)), ", ").alias("__names"))
    ok = F.when(F.col("__n") > 0, F.raise_error(F.concat(F.lit("missing: "), "__names"))).otherwise(True)
    return lost.where(ok).join(held).drop("__n", "__names")


def region_counts(rows: DataFrame, region: str, item: str) -> DataFrame:
    """(region, n_rows, n_items) of each region, and of all of them as 'All'."""
    both = rows.select(F.col(item).alias("item"), F.explode(F.array(F.lit("All"), F.col(region).cast("string"))).alias("region"))
    return both.groupBy("region").agg(F.count("*").alias("n_rows"), F.count_distinct("item").alias("n_items"))


def with_records(items: DataFrame, records: DataFrame, key: str, missing: dict) -> DataFrame:
    """All items with what the records say of them; ``missing`` stands where there is no record. Records: one for each key."""
    both = items.join(records, key, "left")
    return both.select(*[F.coalesce(F.col(c), F.lit(missing[c])).alias(c) if c in missing else F.col(c) for c in both.columns])


def full_paths(rows: DataFrame, paths: DataFrame, key: str, path: str, ranks: int = 7) -> DataFrame:
    """rows with their full path; ids are compared as numbers, whatever they are written as; what is missing or isn't ``ranks`` long has none, and says why."""
    told = paths.select(F.col(key).try_cast("long").alias("__k"), F.col(path).alias("path"))
    both = rows.withColumn("__r", F.col(key).try_cast("long")).join(told, F.col("__r") == F.col("__k"), "left")
    state = F.when(F.col("path").isNull(), "missing").when(F.size("path") != ranks, "malformed").otherwise("ok")
    return both.withColumn("state", state).withColumn("path", F.when(F.col("state") == "ok", F.col("path"))).drop("__r", "__k")


def with_origin(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts in one table, with which of them a row comes from."""
    out = None
    for name, rows in parts.items():
        rows = rows.withColumn("origin", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
