"""Tables of points for panels: which rows, which region of each, and the labels that colour and shape them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import curation, panels


def not_empty(rows: DataFrame, what: str) -> DataFrame:
    """rows; reading them is an error if there are none."""
    n = rows.limit(1).agg(F.count("*").alias("__n"))
    fails = n.where(F.when(F.col("__n") == 0, F.raise_error(F.lit(f"no rows: {what}")).cast("boolean")).otherwise(False))
    return rows.unionByName(fails.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))


def _labelled(rows: DataFrame, color: Column, shape: Column | None = None) -> DataFrame:
    shape = F.lit("") if shape is None else F.coalesce(shape.cast("string"), F.lit(""))
    return rows.withColumn("color_label", color.cast("string")).withColumn("shape_label", shape)


def assigned(rows: DataFrame, key: str, regions: list[int], seed: int = 0) -> DataFrame:
    """rows with region: one of the regions for each row, by hash."""
    return rows.withColumn("region", F.get(F.array(*[F.lit(r).cast("long") for r in regions]), panels.region_choice(F.col(key), len(regions), seed).cast("int")))


def top_taxa_points(rows: DataFrame, rank: str, order: str, n: int) -> DataFrame:
    """Rows of the n most frequent taxa of a rank (ties by first seen), coloured by taxon."""
    found = curation.within_taxa(rows, curation.top_taxa(rows.where(F.col(rank).isNotNull()), rank, order, n), rank)
    return _labelled(not_empty(found, f"top {rank}"), F.col(rank))


def top_inside_points(rows: DataFrame, outer: str, inner: str, shape: str, order: str, n: int, label: str | None = None) -> DataFrame:
    """Rows of the n most frequent inner taxa inside one outer taxon, the most frequent unless named; coloured by inner taxon, shaped by ``shape``."""
    if label is None:
        inside = curation.within_taxa(rows, curation.top_taxa(rows.where(F.col(outer).isNotNull()), outer, order, 1), outer)
    else:
        inside = rows.where(F.col(outer) == label)
    found = curation.within_taxa(inside, curation.top_taxa(inside.where(F.col(inner).isNotNull()), inner, order, n), inner)
    return _labelled(not_empty(found, f"{inner} inside {label or 'the largest ' + outer}"), F.col(inner), F.col(shape))


def taxon_points(rows: DataFrame, rank: str, taxon: str, color: str) -> DataFrame:
    """All rows of one taxon, coloured by a lower rank."""
    return _labelled(not_empty(rows.where(F.col(rank) == taxon), f"{rank} {taxon}"), F.col(color))


def invariance_points(rows: DataFrame, key: str, rank: str, taxon: str, n: int, regions: list[int], ids: list[int] | None = None, seed: int = 0) -> DataFrame:
    """n sequences of one taxon in each of the regions, coloured by sequence: random ones, or the first n of the stated ids that it has.

    Fewer than n to choose from, or none of the stated ids, is an error.
    """
    inside = rows.where(F.col(rank) == taxon)
    if ids is None:
        had = inside.limit(n).agg(F.count("*").alias("__had"))
        few = had.where(F.when(F.col("__had") < n, F.raise_error(F.concat(F.lit(f"fewer than {n} sequences of {taxon}: "), F.col("__had").cast("string"))).cast("boolean")).otherwise(False))
        chosen = curation.first_by_hash(inside, key, n, seed)
        chosen = chosen.unionByName(few.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in chosen.schema]))
    else:
        place = F.array_position(F.array(*[F.lit(k).cast("long") for k in dict.fromkeys(ids)]), F.col(key).cast("long"))
        stated = inside.where(F.col(key).isin(list(ids)))  # as many as are stated
        chosen = not_empty(stated.withColumn("__p", place).orderBy("__p").limit(n).drop("__p"), f"stated sequences of {taxon}")
    each = chosen.withColumn("region", F.explode(F.array(*[F.lit(r).cast("long") for r in regions])))
    return _labelled(each, F.col(key))


def panel_points(parts: dict[str, DataFrame], key: str, regions: list[int], seed: int = 0) -> DataFrame:
    """One table of all panels with panel_name; rows without a region get one of the regions by hash."""
    out = None
    for name, rows in parts.items():
        rows = (rows if "region" in rows.columns else assigned(rows, key, regions, seed)).withColumn("panel_name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
