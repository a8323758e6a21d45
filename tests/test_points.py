"""Small cases of panels of points, depths with training taxa, labels of old maps, files of wrong rows and clusterings run by run."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import clustering, evaluation, points, taxonomy
from rankloom.sources import fasta

ROWS = [(1, "a", "x", "g"), (2, "a", "x", "h"), (3, "a", "y", "g"), (4, "b", "z", "g"), (5, "b", "z", None), (6, "c", "w", "k"), (7, None, None, None)]


@pytest.fixture
def taxa(spark):
    return spark.createDataFrame(ROWS, "id long, r0 string, r1 string, r2 string")


def shown(rows):
    return sorted((r["id"], r["color_label"], r["shape_label"]) for r in rows.collect())


def test_top_and_inside(taxa):
    assert shown(points.top_taxa_points(taxa, "r0", "id", 2)) == [(1, "a", ""), (2, "a", ""), (3, "a", ""), (4, "b", ""), (5, "b", "")]
    assert shown(points.top_inside_points(taxa, "r0", "r1", "r2", "id", 1)) == [(1, "x", "g"), (2, "x", "h")]
    assert shown(points.top_inside_points(taxa, "r0", "r1", "r2", "id", 5, "b")) == [(4, "z", "g"), (5, "z", "")]
    assert shown(points.taxon_points(taxa, "r0", "c", "r1")) == [(6, "w", "")]


@pytest.mark.parametrize("case", ["taxon", "inside", "top"])
def test_a_panel_without_points_is_an_error(taxa, case):
    none = {"taxon": lambda: points.taxon_points(taxa, "r0", "q", "r1"), "inside": lambda: points.top_inside_points(taxa, "r0", "r1", "r2", "id", 2, "q"), "top": lambda: points.top_taxa_points(taxa.limit(0), "r0", "id", 2)}
    with pytest.raises(Exception, match="no rows"):
        none[case]().collect()


def test_each_region_of_some_sequences(taxa):
    got = points.invariance_points(taxa, "id", "r0", "a", 2, [4, 9]).collect()
    assert len(got) == 4 and len({r["id"] for r in got}) == 2 and {r["region"] for r in got} == {4, 9} and all(r["color_label"] == str(r["id"]) for r in got)
    got = points.invariance_points(taxa, "id", "r0", "a", 2, [4], ids=[3, 99, 4, 2, 1]).collect()
    assert sorted(r["id"] for r in got) == [2, 3]
    with pytest.raises(Exception, match="fewer than 4 sequences of a: 3"):
        points.invariance_points(taxa, "id", "r0", "a", 4, [4]).collect()
    with pytest.raises(Exception, match="no rows"):
        points.invariance_points(taxa, "id", "r0", "a", 4, [4], ids=[99]).collect()


def test_panels_share_one_table(taxa):
    parts = {"one": points.taxon_points(taxa, "r0", "a", "r1"), "two": points.invariance_points(taxa, "id", "r0", "b", 2, [7, 8])}
    got = points.panel_points(parts, "id", [5, 6]).collect()
    assert {r["panel_name"]: None for r in got}.keys() == {"one", "two"} and len(got) == 3 + 4
    assert {r["region"] for r in got if r["panel_name"] == "one"} <= {5, 6} and {r["region"] for r in got if r["panel_name"] == "two"} == {7, 8}


def test_depth_stops_at_taxa_without_training_rows(spark):
    rows = spark.createDataFrame([(1, "a", "b", "a", "b"), (2, "a", "n", "a", "n"), (3, "m", "b", "m", "b"), (4, "a", "b", "x", "b"), (5, None, "b", None, "b")], "id int, t0 string, t1 string, p0 string, p1 string")
    train = spark.createDataFrame([("a", "b"), ("a", "c"), (None, None)], "t0 string, t1 string")
    told = evaluation.known_taxa(rows, train, ["t0", "t1"]).withColumn("depth", evaluation.deepest_correct(F.array("t0", "t1"), F.array("p0", "p1"), F.col("known")))
    assert {r["id"]: r["depth"] for r in told.collect()} == {1: 2, 2: 1, 3: 0, 4: 0, 5: 0}
    got = evaluation.depth_counts(told.where("id <> 2").withColumn("g", F.lit(1)), "depth", ["t0", "t1"], ["g"]).collect()
    assert sorted((r["depth"], r["deepest"], r["n_rows"], r["share"]) for r in got) == [(0, "None", 3, 0.75), (1, "t0", 0, 0.0), (2, "t1", 1, 0.25)]


def test_labels_of_old_maps(spark):
    ids = spark.createDataFrame([("d__A", 1), ("A", 2), ("B", 3), ("p__B", 4)], "key string, taxon_id long")
    rows = spark.createDataFrame([("A", 0), ("A", 1), ("B", 0), ("B", 1), ("B", 1)], "label string, rank int")
    assert sorted((r["label"], r["rank"], r["taxon_id"]) for r in taxonomy.resolved_ids(rows, ids, "label", "rank").collect()) == [("A", 0, 1), ("A", 1, 2), ("B", 0, 3), ("B", 1, 4), ("B", 1, 4)]
    for lost in ("C", None):
        with pytest.raises(Exception, match="no taxon id: rank 1"):
            taxonomy.resolved_ids(rows.unionByName(spark.createDataFrame([(lost, 1)], rows.schema)), ids, "label", "rank").collect()


def test_files_of_wrong_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, None, "a"), (4, "a,\"c", "")], "id long, true_g string, pred_g string")
    fasta.write_misclassified(rows, str(tmp_path / "w"), "g", "id")
    got = fasta.read_misclassified(spark, str(tmp_path / "w"), "g").collect()
    assert sorted((r["sequence_index"], r["true_taxon"], r["predicted_taxon"], r["total_num_seqs"]) for r in got) == [("1", "a", "b", 4), ("3", "", "a", 4), ("4", 'a,"c', "", 4)]
    assert "total_num_seqs=4\n" in [p.read_text() for p in (tmp_path / "w" / "g" / "counts").glob("part-*")]
    fasta.write_misclassified(rows.where("id = 2"), str(tmp_path / "n"), "g", "id")
    assert fasta.read_misclassified(spark, str(tmp_path / "n"), "g").count() == 0


def test_runs_take_the_vectors_of_their_plan(spark):
    v = spark.createDataFrame([(i, r, [float(i % 2) + 0.01 * i, 1.0 - (i % 2) + 0.02 * r], "ab"[i % 2]) for i in range(12) for r in range(2)], "item long, region int, v array<double>, label string")
    plan = spark.createDataFrame([(k, i, (i * k) % 2) for k in range(2) for i in range(11)], "run long, item long, region int")
    got = clustering.evaluated_runs(v, plan, [0, 1], "item", "region", "v", ["label"], {"all": F.lit(True)}, (False,), 5)
    own = {k: clustering.evaluated(v.join(plan.where(F.col("run") == k), ["item", "region"]), "item", "v", ["label"], {"all": F.lit(True)}, (False,), 5).first() for k in (0, 1)}
    rows = {r["run"]: r for r in got.collect()}
    assert rows.keys() == own.keys()
    for k, one in own.items():
        assert rows[k]["n_rows"] == 11 and all(rows[k][c] == one[c] for c in one.asDict())
