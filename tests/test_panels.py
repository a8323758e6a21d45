"""Hand-checkable cases of regions, panels, predictions beside the truth and series; every query of the catalogue against its SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom import catalogue, inventory, registry
from rankloom.operators import panels

REGIONS = [(0, "FULL"), (1, "V3"), (2, "V4")]


def regions(spark):
    return spark.createDataFrame(REGIONS, "region_idx int, region_id string")


def test_selected_regions(spark):
    got = panels.selected_regions(regions(spark), ["V4", 2, "1"]).collect()
    assert sorted(r["region_id"] for r in got) == ["V3", "V4"]
    with pytest.raises(Exception, match="unknown region: V9"):
        panels.selected_regions(regions(spark), ["V9"]).collect()


def test_usable_regions_leave_out_the_full_sequence(spark):
    got = panels.usable_regions(regions(spark), 1, regions(spark)).collect()
    assert [r["region_id"] for r in got] == ["V3"]


def test_other_region_differs(spark):
    rows = spark.range(500).withColumn("a", panels.region_choice(F.col("id"), 5)).withColumn("b", panels.other_region(F.col("a"), F.col("id"), 5))
    assert rows.where("a = b OR b NOT BETWEEN 0 AND 4").count() == 0
    assert rows.select("b").distinct().count() == 5


def test_hierarchy(spark):
    rows = spark.createDataFrame([("B", "x", "2"), ("B", "x", "1"), ("B", "a", "9"), ("B", "x", "2"), ("A", "q", "0")], "r0 string, r1 string, r2 string")
    assert {r["r0"]: r["tree"] for r in panels.hierarchy(rows, ["r0", "r1", "r2"]).collect()} == {"B": "a(9),x(1,2)", "A": "q(0)"}


def test_missing_rows_differ_from_empty_predictions(spark):
    true = spark.createDataFrame([(1, "a"), (2, "b")], "id int, true string")
    one = spark.createDataFrame([(1, "")], "id int, pred string")
    got = {r["id"]: (r["pred_m"], r["pred_n"]) for r in panels.beside_truth(true, {"m": one, "n": one.limit(0)}, "id").collect()}
    assert got == {1: ("", None), 2: (None, None)}


def test_seen_scores(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "c"), ("b", None)], "true string, pred string").withColumn("g", F.lit(1))
    r = panels.seen_scores(rows, spark.createDataFrame([("a",), ("b",), ("b",)], "label string"), ["g"]).first()
    assert (r["n_rows"], r["n_wrong"], r["accuracy"], r["macro"]) == (4, 2, 0.5, 0.5)


def test_series_and_codes(spark):
    h = spark.createDataFrame([("s", 1, None), ("s", 2, 0.3), ("s", 3, 0.9), ("t", 1, None)], "k string, o int, v double")
    assert {r["k"]: (r["best"], r["baseline"]) for r in panels.best_of_series(h, "k", "o", "v").collect()} == {"s": (0.9, 0.3), "t": (None, None)}
    rows = spark.createDataFrame([("b",), ("a",), ("",), (None,), ("b",)], "l string")
    assert sorted((r["l"] or "", r["code"]) for r in panels.local_codes(rows, "l").collect()) == [("", -1), ("", -1), ("a", 0), ("b", 1), ("b", 1)]


NEW = [n for n, f in registry.QUERIES.items() if f.__module__ in (catalogue.__name__, inventory.__name__) and n in registry.ORACLE_SQL]


def plain(rows):
    return sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    got = registry.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert plain(got.select(*cols).collect()) == plain(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())


def test_required_numbers_and_records(spark):
    held = spark.createDataFrame([(4, "a"), (5, "b")], "k long, x string")
    assert panels.require_all([5, 4], held, "k").count() == 2
    with pytest.raises(Exception, match="missing: 7, 9"):
        panels.require_all([9, 4, 7], held, "k").collect()
    items = spark.createDataFrame([(4,), (6,)], "k long")
    assert {tuple(r) for r in panels.with_records(items, held, "k", {"x": "-"}).collect()} == {(4, "a"), (6, "-")}
    counts = panels.region_counts(spark.createDataFrame([(1, "V3"), (1, "V4"), (2, "V4")], "i long, region string"), "region", "i")
    assert {tuple(r) for r in counts.collect()} == {("All", 3, 2), ("V3", 1, 1), ("V4", 2, 2)}
