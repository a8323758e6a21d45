"""The first rows of a few groups in a total order, by thresholds found from counted ranges instead of a sort.

Each group's range of whole numbers is cut into equal ranges that are counted; the one in
which the wanted row lies is cut again, for all groups in one pass, until it is one number.
The rows are then filtered by their group's threshold. What the driver holds is groups x
RANGES counts, whatever the number of rows and however many of them one group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Scratch

#: Ranges that are counted at once for each group.
RANGES = 4096


def counts(rows: DataFrame, by: str) -> dict:
    """group -> rows; for groups of which there are few."""
    return {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}


def of_group(by: str, told: dict, default) -> Column:
    """A group's value as a column. A null group is one like any other."""
    out = F.lit(default)
    for g, v in told.items():
        out = F.when(F.col(by).eqNullSafe(F.lit(g)), F.lit(v)).otherwise(out)
    return out


def thresholds(rows: DataFrame, by: str, value: str, need: dict) -> dict:
    """group -> (t, n below t): the value of the need-th smallest row of each group in ``need``, each of which has that many rows. Values are whole numbers."""
    asked = rows.where(of_group(by, dict.fromkeys(need, True), False)).select(by, F.col(value).cast("decimal(20,0)").alias("v"))
    ends = {r[by]: [int(r["a"]), int(r["b"]), 0] for r in asked.groupBy(by).agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()}
    asked = asked.withColumn("v", F.col("v").cast("long"))
    while open_ := {g: e for g, e in ends.items() if e[0] < e[1]}:
        step = {g: -(-(e[1] - e[0] + 1) // RANGES) for g, e in open_.items()}
        low, high = of_group(by, {g: e[0] for g, e in open_.items()}, 0), of_group(by, {g: e[1] for g, e in open_.items()}, -1)
        width = of_group(by, {g: min(s, (1 << 63) - 1) for g, s in step.items()}, 1)
        inside = asked.where(F.col("v").between(low, high))
        place = F.call_function("div", F.col("v").cast("decimal(38,0)") - low, width).cast("int")
        got: dict = {}
        for r in inside.groupBy(by, place.alias("k")).agg(F.count("*").alias("n")).collect():
            got.setdefault(r[by], []).append((r["k"], r["n"]))
        for g, e in open_.items():
            for k, n in sorted(got[g]):
                if e[2] + n >= need[g]:
                    e[0], e[1] = e[0] + k * step[g], min(e[1], e[0] + (k + 1) * step[g] - 1)
                    break
                e[2] += n
    return {g: (e[0], e[2]) for g, e in ends.items()}


def first_rows(rows: DataFrame, by: str, order: str, tie: str, cap: int | dict, scratch: Scratch | None = None) -> DataFrame:
    """rows, at most ``cap`` (or cap[group]) of each group: those with the smallest order, among equals with the smallest tie, among equals in both any. Order and tie are whole numbers.

    A group of fewer rows stays whole. The rows are written first, as they are read a few times.
    """
    own, number = scratch or Scratch(rows.sparkSession), "__row"
    while number in rows.columns:
        number += "_"
    rows = own.write(rows.withColumn(number, F.monotonically_increasing_id()), "candidates")
    have = counts(rows, by)
    left = {g: cap if isinstance(cap, int) else cap.get(g, 0) for g in have}
    kept, edge = F.lit(False), F.lit(True)
    among = lambda groups: of_group(by, dict.fromkeys(groups, True), False)
    # Rows at the threshold of one column are told apart by the next; no two rows have one number.
    for column in (order, tie, number):
        kept = kept | edge & among([g for g, n in have.items() if left[g] >= n])
        need = {g: left[g] for g, n in have.items() if 0 < left[g] < n}
        if not need:
            return rows.where(kept).drop(number)
        at = thresholds(rows.where(edge), by, column, need)
        edge = edge & among(need)
        value = of_group(by, {g: t for g, (t, _) in at.items()}, 0)
        kept = kept | edge & (F.col(column) < value)
        edge = edge & (F.col(column) == value)
        left = {g: need[g] - n for g, (_, n) in at.items()}
        have = counts(rows.where(edge), by)
    return rows.where(kept | edge).drop(number)


def shortages(rows: DataFrame, by: str, cap: int) -> DataFrame:
    """(by, wanted, have, short): groups that have fewer rows than are wanted of them."""
    return rows.groupBy(by).agg(F.count("*").alias("have")).where(F.col("have") < cap).select(by, F.lit(cap).cast("long").alias("wanted"), "have", (F.lit(cap) - F.col("have")).cast("long").alias("short"))
