"""Places, quantiles and values carried on in the order of a whole table or of few large groups, without a task for each group.

Rows are range-partitioned by group and order and written once. A row's place is then its
place in its own partition plus the rows of its group in the partitions before, which
come from counts of (group, partition): as many rows as there are groups and partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Scratch, written


#: Rows of a few numbers each that may meet in one task.
FEW = 200_000


def spread(rows: DataFrame, by: list[str], order: list[str], scratch: Scratch | None = None) -> DataFrame:
    """rows, range-partitioned by group and order, with their partition in ``__p``; written, so that it stays what it is."""
    return (scratch.write if scratch else written)(rows.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()), "ordered")


def _before(parts: DataFrame, by: list[str], value: str) -> Column:
    """Sum of a value over the partitions of the same group before this one."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _join(rows: DataFrame, parts: DataFrame, by: list[str], keys: tuple[str, ...] = ("__p",)) -> DataFrame:
    """rows with the columns of parts, by group (nulls are a group) and keys."""
    on, right = F.lit(True), parts.select(*[F.col(c).alias(f"__j_{c}") for c in (*by, *keys)], *[c for c in parts.columns if c not in (*by, *keys)])
    for c in (*by, *keys):
        on = on & rows[c].eqNullSafe(F.col(f"__j_{c}"))
    return rows.join(right, on, "left").drop(*[f"__j_{c}" for c in (*by, *keys)])


def numbered(rows: DataFrame, by: list[str], order: list[str], place: str = "__place", size: str | None = None) -> DataFrame:
    """rows with their place from 0 on inside their group, in a total order of columns, and the group's size if it is named."""
    cut = spread(rows, by, order)
    counts = cut.groupBy(*by, "__p").agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*by)
    counts = counts.select(*by, "__p", _before(counts, by, "__c").alias("__b"), F.sum("__c").over(whole).alias("__all"))
    inside = Window.partitionBy("__p", *by).orderBy(*order)
    out = _join(cut.withColumn("__i", F.row_number().over(inside) - 1), counts, by)
    out = out.withColumn(place, F.col("__b") + F.col("__i"))
    if size is not None:
        out = out.withColumn(size, F.col("__all"))
    return out.drop("__p", "__i", "__b", *([] if size == "__all" else ["__all"]))


def cumulated(rows: DataFrame, by: list[str], order: list[str], weight: str, name: str, total: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """rows with the sum of a weight over the rows before them in their group, and over all of the group if it is named.

    The rows, counted values as a rule, are written. Up to FEW of them are summed up group by group, more over range partitions.
    """
    rows = (scratch.write if scratch else written)(rows, "counted")
    if rows.count() <= FEW:
        upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = rows.withColumn(name, F.coalesce(F.sum(weight).over(upto), F.lit(0)))
        return out if total is None else out.withColumn(total, F.sum(weight).over(Window.partitionBy(*by)))
    cut = spread(rows, by, order, scratch)
    sums = cut.groupBy(*by, "__p").agg(F.sum(weight).alias("__c"))
    sums = sums.select(*by, "__p", _before(sums, by, "__c").alias("__b"), F.sum("__c").over(Window.partitionBy(*by)).alias("__all"))
    inside = F.sum(weight).over(Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = _join(cut.withColumn("__r", F.coalesce(inside, F.lit(0))), sums, by).withColumn(name, F.col("__b") + F.col("__r"))
    if total is not None:
        out = out.withColumn(total, F.col("__all"))
    return out.drop("__p", "__r", "__b", *([] if total == "__all" else ["__all"]))


def quantiles(rows: DataFrame, by: list[str], value: str, points: list[float], name: str = "q", weight: str | None = None) -> DataFrame:
    """(by, n_rows, name): interpolated quantiles of a value inside each group as array<double>; nulls don't count.

    Equal values are counted first (or come counted, with their weight) and written once. The result is written, a row for each
    group, and what led up to it removed.
    """
    scratch = Scratch(rows.sparkSession)
    one = F.count("*") if weight is None else F.sum(weight)
    held = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(one.alias("__w"))
    at = cumulated(held, by, [value], "__w", "__from", "n_rows", scratch)
    at = at.withColumn("__v", F.col(value).cast("double")).withColumn("__upto", F.col("__from") + F.col("__w"))
    place = lambda p: F.lit(float(p)) * (F.col("n_rows") - 1)
    low, high = [F.floor(F.round(place(p), 9)) for p in points], [F.ceil(F.round(place(p), 9)) for p in points]
    inside = lambda k: (F.col("__from") <= k) & (k < F.col("__upto"))
    needed = F.lit(False)
    for k in (*low, *high):
        needed = needed | inside(k)
    ends = [x for p in range(len(points)) for x in (F.max(F.when(inside(low[p]), F.col("__v"))).alias(f"__l{p}"), F.max(F.when(inside(high[p]), F.col("__v"))).alias(f"__h{p}"))]
    got = at.where(needed).groupBy(*by, "n_rows").agg(*ends)
    between = [F.col(f"__l{k}") + (F.col(f"__h{k}") - F.col(f"__l{k}")) * (place(p) - F.floor(F.round(place(p), 9))) for k, p in enumerate(points)]
    return scratch.result(got.select(*by, "n_rows", F.array(*between).alias(name)), "quantiles")


def _beside(got: DataFrame, by: list[str], q: DataFrame, points: dict[str, float]) -> DataFrame:
    return _join(got, q.drop("n_rows"), by, ()).select(*got.columns, *[F.round(F.get("__q", F.lit(k)), 6).alias(n) for k, n in enumerate(points)])


def with_quantiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float], stats: list[Column]) -> DataFrame:
    """(by, stats.., one rounded column for each point): statistics in one aggregation, quantiles beside them."""
    return _beside(rows.groupBy(*by).agg(*stats), by, quantiles(rows, by, value, list(points.values()), "__q"), points)


def weighted_quantiles(counted: DataFrame, by: list[str], value: str, weight: str, points: dict[str, float], stats: list[Column]) -> DataFrame:
    """The same of values that come with their counts."""
    return _beside(counted.groupBy(*by).agg(*stats), by, quantiles(counted, by, value, list(points.values()), "__q", weight), points)


def long_form(rows: DataFrame, sets: list[list[str]], values: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """(columns of all sets, value, x, keep..): each row once for each set of columns and each value; 'All' stands for what a set doesn't group by."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    forms = [
        F.struct(*[(F.col(c).cast("string") if c in by else F.lit("All")).alias(c) for c in names], F.lit(v).alias("value"), x.cast("double").alias("x")) for by in sets for v, x in values.items()
    ]
    return rows.select(F.explode(F.array(*forms)).alias("__f"), *(keep or [])).select("__f.*", *(keep or []))


def carried_on(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows in which a missing value is the last one before it in its group, across partitions too."""
    cut = spread(rows, by, order)
    until = Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = cut.groupBy(*by, "__p").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__last"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(*by, "__p", F.last("__last", ignorenulls=True).over(before).alias("__came"))
    filled = cut.withColumn("__here", F.last(value, ignorenulls=True).over(until))
    return _join(filled, lasts, by).withColumn(value, F.coalesce("__here", "__came")).drop("__p", "__here", "__came")


def beside_previous(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the value of the row before in their group, null for the first."""
    placed = numbered(rows, by, order)
    placed = written(placed, "placed")
    before = placed.select(*by, (F.col("__place") + 1).alias("__place"), F.col(value).alias(name))
    return _join(placed, before, by, ("__place",)).drop("__place")
