"""More queries by operator id: files written and read again, regions, panels, predictions, series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import curation, evaluation, logs, mining, panels
from .plans import adapters as A
from .plans.adapters import sql
from .registry import ORACLE_SQL, QUERIES, query
from .sources import fasta

__all__ = ["ORACLE_SQL", "QUERIES"]

# Files


@query("A1_A5_A17_fasta", sql("seqs", "SELECT 'G' || doc_id AS genome_id, lang AS t0, length(dna)::BIGINT AS n, sha256(dna) AS dna_sha256 FROM seqs"))
def fasta_files(spark, d) -> DataFrame:
    path = fasta.work_folder(spark, "fasta")
    fasta.write_fasta(A.seqs(spark, d).select(F.concat(F.lit("G"), F.col("doc_id").cast("string"), F.lit("~c1 d__"), "lang", F.lit(";p__"), "source").alias("header"), F.col("dna").alias("seq")), path)
    got, h = fasta.read_fasta(spark, path), F.col("header")
    return got.select(S.genome_id(h).alias("genome_id"), F.get(S.taxonomy_path(h), F.lit(0)).alias("t0"), F.length("seq").cast("long").alias("n"), F.sha2("seq", 256).alias("dna_sha256"))


@query("A13_A19_A22_csv", sql("preds", "SELECT id::VARCHAR AS id, true_ AS true_label, pred FROM preds"))
def csv_files(spark, d):
    path = fasta.work_folder(spark, "csv")
    A.preds(spark, d).select("id", F.col("true").alias("true_label"), "pred").write.csv(path, header=True)
    return fasta.read_strings(spark, path)


@query("A9_A20_U2_index_files", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def index_files(spark, d):
    path = fasta.work_folder(spark, "indices")
    ids = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    for name, rows in (("all", ids), ("excluded", ids.where("id % 5 = 0")), ("test", ids.where("id % 7 = 0"))):
        rows.select(F.col("id").cast("string").alias("value")).write.text(f"{path}/{name}")
    left_out = fasta.read_indices(spark, f"{path}/excluded", f"{path}/test")
    return fasta.read_indices(spark, f"{path}/all").join(left_out, "id", "left_anti")


# Regions


def _regions(spark, d) -> DataFrame:
    return A.table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("region_idx")).distinct().withColumn("region_id", F.when(F.col("region_idx") == 0, "FULL").otherwise(F.concat(F.lit("R"), F.col("region_idx").cast("string"))))


@query("F11_F13_U3_regions", """SELECT (l_linenumber - 1)::BIGINT AS region_idx, 'R' || (l_linenumber - 1) AS region_id, count(*) AS n_rows
FROM lineitem
WHERE l_linenumber IN (3, 4)
GROUP BY l_linenumber""")
def usable(spark, d):
    regions = _regions(spark, d)
    pool = panels.usable_regions(regions, 4, panels.selected_regions(regions, ["R2", 3, "R2", 2, "FULL", 5]))
    rows = A.table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("region_idx"))
    return rows.join(F.broadcast(pool), "region_idx").groupBy(F.col("region_idx").cast("long").alias("region_idx"), "region_id").agg(F.count("*").alias("n_rows"))


@query("F25_F26_region_choice", """SELECT id, r AS region, (r + 1 + (id * 1103515245 + 12346) % 2147483648 % 6) % 7 AS other
FROM (SELECT c_custkey AS id, (c_custkey * 1103515245 + 12345) % 2147483648 % 7 AS r
FROM customer)""")
def region_choice(spark, d):
    rows = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).withColumn("region", panels.region_choice(F.col("id"), 7))
    return rows.withColumn("other", panels.other_region(F.col("region"), F.col("id"), 7))


@query("J2_region_records", """SELECT o_orderkey AS id, coalesce(n, 0) AS n_lines, coalesce(flags, '----') AS codes
FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_returnflag) || max(l_returnflag) || min(l_linestatus) || max(l_linestatus) AS flags
FROM lineitem
GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def region_records(spark, d):
    found = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.concat(F.min("l_returnflag"), F.max("l_returnflag"), F.min("l_linestatus"), F.max("l_linestatus")).alias("flags"))
    got = panels.with_records(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), found, "id", {"n": 0, "flags": "----"})
    return got.select("id", F.col("n").alias("n_lines"), F.col("flags").alias("codes"))


# Filters and panels


@query("F2_F9_resolution", """SELECT coalesce(lang, 'All') AS domain, sum((doc_id % 3 >= 1)::INT)::BIGINT AS kept, sum((doc_id % 3 < 1)::INT)::BIGINT AS removed
FROM documents
GROUP BY ROLLUP (lang)""")
def resolution(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", "lang", F.concat(F.array("lang", "source"), F.array_repeat(F.lit("x"), (F.col("doc_id") % 3 + 3).cast("int"))).alias("path"))
    kept = curation.resolved(rows, "path", 6).rollup("lang").agg(F.count("*").alias("kept"))
    total = rows.rollup("lang").agg(F.count("*").alias("n"))
    both = total.join(kept, total["lang"].eqNullSafe(kept["lang"]), "left")  # one row for each domain
    return both.select(F.coalesce(total["lang"], F.lit("All")).alias("domain"), F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("removed"))


@query("F19_W17_schedule", sql("history", "SELECT batch, rank, count(*) AS n_rows FROM history WHERE (batch = 1 OR batch % 5 = 0) AND (rank <> 'click' OR batch >= 10) GROUP BY ALL"))
def schedule(spark, d):
    batch = F.col("batch")
    return A.history(spark, d).where(logs.due(batch, 5) & logs.introduced(F.col("rank"), batch, {"click": 10})).groupBy("batch", "rank").agg(F.count("*").alias("n_rows"))


@query("F21_S24_triplets", sql("mined", "SELECT i AS anchor, j AS positive, round(0.5 * (true_ - pred), 6) AS margin FROM mined WHERE round(true_, 9) > round(pred, 9)"))
def ordered_triplets(spark, d):
    m = mining.in_true_order(A.mined(spark, d), "pred", "true")
    return m.select(F.col("i").alias("anchor"), F.col("j").alias("positive"), F.round(S.margin(F.col("pred"), F.col("true"), 0.5), 6).alias("margin"))


@query("F23_panel", sql("tax4", """, o AS (SELECT r0
FROM tax4
GROUP BY r0
ORDER BY count(*) DESC, min(id) LIMIT 1),
f AS (SELECT r1
FROM tax4
WHERE r0 IN (FROM o)
GROUP BY r1
ORDER BY count(*) DESC, min(id) LIMIT 3) SELECT id, r0, r1
FROM tax4
WHERE r0 IN (FROM o) AND r1 IN (FROM f)"""))
def panel(spark, d):
    return panels.largest_panel(A.tax4(spark, d), "r0", "r1", "id", 3).select("id", "r0", "r1")


@query("G8_hierarchy", sql("tax4", """, a AS (SELECT r0, r1, string_agg(DISTINCT r2, ','
ORDER BY r2) AS t
FROM tax4
GROUP BY r0, r1) SELECT r0, string_agg(r1 || '(' || t || ')', ','
ORDER BY r1 || '(' || t || ')') AS tree
FROM a
GROUP BY r0"""))
def nested(spark, d):
    return panels.hierarchy(A.tax4(spark, d), ["r0", "r1", "r2"])


_POINTS = (0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


@query("G2_length_quantiles", sql("seqs", "SELECT lang, length(dna) >= 40 AS passed, count(*) AS n_rows, " + ", ".join(f"round(quantile_cont(length(dna), {p}), 6) AS q{k}" for k, p in enumerate(_POINTS)) + " FROM seqs GROUP BY ALL"))
def quantiles(spark, d):
    return panels.length_quantiles(A.seqs(spark, d).withColumn("passed", F.length("dna") >= 40), "dna", ["lang", "passed"], _POINTS)


@query("G54_G55_repeated", """SELECT count(*) AS n_taxa, sum((c > 1)::INT)::BIGINT AS n_repeated, round(avg((c > 1)::INT) * 100, 6) AS percent
FROM (SELECT count(*) AS c
FROM documents
GROUP BY text)""")
def repeated(spark, d):
    return panels.repeated_share(A.table(spark, d, "documents"), "text")


@query("K5_K6_slack", sql("seqs", """, c AS (SELECT doc_id, left(dna, 600) AS s
FROM seqs),
o AS (SELECT *, (doc_id * 1103515245 + 12345) % 2147483648 % (601 - length(s)) AS shift
FROM c) SELECT doc_id, shift, rpad(repeat('-', shift::INT) || s, 600, '-') AS fitted
FROM o"""))
def slack(spark, d):
    rows = A.seqs(spark, d).select("doc_id", S.clamped(F.col("dna"), 600).alias("s")).withColumn("shift", S.slack_shift(F.col("s"), F.col("doc_id"), 600))
    return rows.select("doc_id", "shift", S.shifted(F.col("s"), F.col("shift"), 600).alias("fitted"))


@query("K8_J15_duplicates", """WITH s AS (SELECT c_custkey AS id
FROM customer
ORDER BY (c_custkey * 1103515245 + 12345) % 2147483648, c_custkey LIMIT (SELECT floor(count(*) * 0.1)::BIGINT
FROM customer)) SELECT id + 1000000 AS duplicate, id AS original, c_mktsegment AS label
FROM s JOIN customer ON id = c_custkey""")
def duplicates(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    copies = curation.share_by_hash(c.select("id"), "id", 0.1, down=True).select((F.col("id") + 1000000).alias("duplicate"), "id")
    return copies.join(c, "id").select("duplicate", F.col("id").alias("original"), F.col("c_mktsegment").alias("label"))


# Predictions


@query("F28_J3_beside_truth", sql("tax4", """, a AS (SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE r2 END AS pred FROM tax4 WHERE id % 5 <> 0), b AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'BUILDING' ELSE r2 END AS pred FROM tax4 WHERE id % 11 <> 0)
SELECT id, r2 AS true_label, a.pred AS pred_a, b.pred AS pred_b, r2 <> 'MACHINERY' AND coalesce(a.pred, '-') <> '' AS valid_a, r2 <> 'MACHINERY' AND b.pred IS NOT NULL AND b.pred <> '' AS valid_b FROM tax4 LEFT JOIN a USING (id) LEFT JOIN b USING (id)"""))
def beside(spark, d):
    t = A.tax4(spark, d).select("id", F.col("r2").alias("true_label"))
    a = t.where("id % 5 <> 0").select("id", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("true_label")).alias("pred"))
    b = t.where("id % 11 <> 0").select("id", F.when(F.col("id") % 3 == 0, "BUILDING").otherwise(F.col("true_label")).alias("pred"))
    known = F.col("true_label") != "MACHINERY"
    return panels.beside_truth(t, {"a": a, "b": b}, "id").select("*", evaluation.valid(F.col("pred_a"), known).alias("valid_a"), evaluation.valid(F.col("pred_b"), known, False).alias("valid_b"))


@query("G13_seen_scores", sql("preds", """, t AS (SELECT region, true_, count(*) AS n, sum((true_ = pred)::INT) AS h
FROM preds
WHERE true_ IN ('A', 'N')
GROUP BY ALL) SELECT region, sum(n)::BIGINT AS n_rows, sum(n - h)::BIGINT AS n_wrong, round(sum(h) / sum(n), 6) AS accuracy, round(avg(h / n), 6) AS macro
FROM t
GROUP BY region"""))
def seen(spark, d):
    labels = spark.createDataFrame([("A",), ("N",)], "label string")
    return panels.seen_scores(A.preds(spark, d), labels, ["region"])


@query("G19_region_pairs", sql("preds", "SELECT region, status, count(*) AS n_valid, round(avg((true_ = pred)::INT), 6) AS accuracy FROM preds WHERE pred <> '' GROUP BY ALL"))
def region_pairs(spark, d):
    return evaluation.accuracy(A.preds(spark, d).where("pred <> ''"), ["region", "status"])


@query("G24_frequent_taxa", sql("preds", """SELECT true_ || region AS taxon, count(*) AS n_rows, round(avg((true_ = pred)::INT), 6) AS accuracy
FROM preds
GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10"""))
def frequent(spark, d):
    return panels.frequent_taxa(A.preds(spark, d).withColumn("taxon", F.concat("true", F.col("region").cast("string"))), "taxon", 10)


@query("J9_inside", sql("mined", """SELECT i, j, rank::BIGINT AS rank
FROM mined
WHERE i IN (SELECT o_orderkey
FROM orders
WHERE o_orderpriority = '1-URGENT') AND j IN (SELECT o_orderkey
FROM orders
WHERE o_orderpriority = '1-URGENT')"""))
def inside(spark, d):
    keys = A.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return panels.inside(A.mined(spark, d), keys, "o_orderkey").select("i", "j", F.col("rank").cast("long").alias("rank"))


# Series, counts and codes


@query("G57_best_of_series", sql("history", """SELECT rank, max(s) AS best, arg_min(s, event_id) FILTER (s IS NOT NULL) AS baseline
FROM (SELECT rank, event_id, CASE WHEN event_id % 3 = 0 THEN round(loss, 6) END AS s
FROM history)
GROUP BY rank"""))
def series(spark, d):
    h = A.history(spark, d).select("rank", "event_id", F.when(F.col("event_id") % 3 == 0, F.round("loss", 6)).alias("score"))
    return panels.best_of_series(h, "rank", "event_id", "score")


@query("M4_scaled_counts", sql("tax4", """, k AS (SELECT r0, avg((id % 4 = 0)::INT) AS share
FROM tax4
GROUP BY r0) SELECT r0, r1, count(*) AS n, round(count(*) * max(share), 6) AS scaled
FROM tax4 JOIN k USING (r0)
GROUP BY r0, r1"""))
def scaled(spark, d):
    t = A.tax4(spark, d)
    kept = t.groupBy("r0").agg(F.avg((F.col("id") % 4 == 0).cast("double")).alias("share"))
    return panels.scaled_counts(t.groupBy("r0", "r1").agg(F.count("*").alias("n")), "r0", "n", kept).withColumn("scaled", F.round("scaled", 6))


@query("J7_O16_local_codes", sql("tax4", """, l AS (SELECT id, CASE WHEN id % 9 = 0 THEN '' ELSE r1 END AS label
FROM tax4),
c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
FROM (SELECT DISTINCT label
FROM l
WHERE label <> '')) SELECT id, label, coalesce(code, -1) AS code
FROM l
LEFT JOIN c USING (label)"""))
def codes(spark, d):
    return panels.local_codes(A.tax4(spark, d).select("id", F.when(F.col("id") % 9 == 0, "").otherwise(F.col("r1")).alias("label")), "label").select("id", "label", "code")


@query("C6_skipped_runs", sql("preds", "SELECT id // 10 % 500 AS run, region, count(DISTINCT true_) AS n_labels FROM preds GROUP BY ALL HAVING count(DISTINCT true_) < 3"))
def skipped(spark, d):
    return panels.skipped_runs(A.preds(spark, d).withColumn("run", F.floor(F.col("id") / 10) % 500), ["run", "region"], "true", 3)
