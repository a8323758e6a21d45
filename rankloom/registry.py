"""Queries by operator id, each over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import classification, clustering, curation, evaluation, kmers, logs, mining, neighbours, ordering, sparse, taxonomy, trees, vector_index
from .plans import adapters as A
from .plans.adapters import sql
from .plans.shared import written

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            ORACLE_SQL[name] = text
        return f

    return add


# Scans, headers, scalar functions


def _headers(spark, d) -> DataFrame:
    return A.table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("{"), (F.col("doc_id") + 1).cast("string"), F.lit("_R2}G"), F.col("doc_id").cast("string"), F.lit("~c1 d__"), "lang", F.lit(";p__"), "source", F.lit(" [location=1..9]")).alias("header")
    )


@query("S1_S6_headers", """SELECT doc_id, 'G' || doc_id AS genome_id, doc_id + 1 AS idx, 'R2' AS region, lang AS t0, source AS t1, '' AS t6, 2::BIGINT AS n_ranks, 'd__' || lang AS qualified, coalesce(nullif('', ''), '__unknown__') AS label6 FROM documents""")
def headers(spark, d):
    h, path = F.col("header"), S.taxonomy_path(F.col("header"))
    pad = S.padded_path(path)
    at = lambda k: F.get(pad, F.lit(k))
    told = [S.genome_id(h).alias("genome_id"), S.header_index(h).alias("idx"), S.header_region(h).alias("region")]
    ranks = [at(0).alias("t0"), at(1).alias("t1"), at(6).alias("t6"), F.size(path).cast("long").alias("n_ranks")]
    return _headers(spark, d).select("doc_id", *told, *ranks, S.qualified(at(0), 0).alias("qualified"), S.rank_label(pad, 6).alias("label6"))


@query("S7_S9_base_codes", sql("seqs", """SELECT doc_id, length(dna)::BIGINT AS n, list_sum(list_transform(string_split(left(dna, 600), ''), lambda c: CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END))::BIGINT + 4 * greatest(0, 600 - length(dna)) AS code_sum
FROM seqs
WHERE length(dna) > 0"""))
def base_codes(spark, d):
    codes = S.fitted(S.base_codes(F.col("dna")), 600)
    return A.seqs(spark, d).where("length(dna) > 0").select("doc_id", F.length("dna").cast("long").alias("n"), F.aggregate(codes, F.lit(0), lambda s, x: s + x).cast("long").alias("code_sum"))


@query("S12_S13_vectors", sql("vecs", """SELECT a.vec_id, round(1 - list_dot_product(a.v, b.v), 6) AS cosine, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS sq
FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1"""))
def vectors(spark, d):
    v = A.vecs(spark, d)
    a, b = v.select("vec_id", F.col("v").alias("a")), v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(S.cosine_distance(F.col("a"), F.col("b")), 6).alias("cosine"), F.round(S.squared_distance(F.col("a"), F.col("b")), 6).alias("sq"))


@query("S14_S16_S19_S21_S25_S28_scores", sql("mined", """SELECT i, j, round(0.6 * pow(CASE WHEN rank >= 0 THEN true_ * 0.75 END, log2(2 / 0.6)), 6) AS adjusted, round(err, 6) AS rel, round(exp(greatest(-20, least(20, 0.5 * sign(pred - true_)))), 6) AS bias,
 round(least(2.0, err), 6) AS loss, round(least(4.0, greatest(0.0, pred - true_ + 0.3)), 6) AS tri, round(0.5 * exp(-0.1) * err + 0.05, 6) AS weighted, round(1.0 / (pred * pred + 0.000001), 4) AS vote,
 CASE WHEN rank <= 2 THEN 1.0 WHEN rank >= 5 THEN 0.0 ELSE round(1.0 - (rank - 2) / 3.0, 6) END AS warm, 'Full-R' || (rank + 1) AS regions FROM mined"""))
def scores(spark, d):
    p, t = F.col("pred"), F.col("true")
    return A.mined(spark, d).select(
        "i", "j", F.round(S.adjusted_distance(t, F.col("rank") >= 0, F.lit(0.75)), 6).alias("adjusted"), F.round(S.relative_error(p, t), 6).alias("rel"), F.round(S.sign_bias(p, t, 0.5), 6).alias("bias"), F.round(S.pair_loss(p, t), 6).alias("loss"),
        F.round(S.triplet_loss(p, t, F.lit(0.3)), 6).alias("tri"), F.round(S.uncertainty_weighted(S.relative_error(p, t), F.lit(0.1)), 6).alias("weighted"), F.round(S.distance_vote(p), 4).alias("vote"), F.round(S.warm_up(F.col("rank"), 2, 5), 6).alias("warm"),
        S.region_pair(F.lit(0), F.col("rank") + 1).alias("regions"),
    )


# Curation and sampling


@query("F1_J1_members", "SELECT n_nationkey::BIGINT AS n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier) AS matched FROM nation")
def members(spark, d):
    n = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    s = A.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    yes, no = curation.members(n, s, "k"), n.join(s.distinct(), "k", "left_anti")
    return yes.withColumn("matched", F.lit(True)).unionByName(no.withColumn("matched", F.lit(False))).select(F.col("k").cast("long").alias("n_nationkey"), "matched")


@query("F3_F4_dedupe_length", sql("seqs", "SELECT min(doc_id) AS doc_id, length(dna)::BIGINT AS n FROM seqs GROUP BY dna HAVING length(dna) BETWEEN 40 AND 600"))
def dedupe_length(spark, d):
    rows = curation.first_of_each(A.seqs(spark, d), "dna", "doc_id")
    return curation.length_between(rows, "dna", 40, 600).select("doc_id", F.length("dna").cast("long").alias("n"))


@query("F5_F6_taxon_sizes", sql("tax4", """, c AS (SELECT *, row_number() OVER (PARTITION BY r0, r1 ORDER BY (id * 1103515245 + 12345) % 2147483648, id) AS n FROM tax4), k AS (SELECT * FROM c WHERE n <= 50)
SELECT id, r0, r1 FROM (SELECT *, count(*) OVER (PARTITION BY r0, r1) AS m FROM k) WHERE m >= 45"""))
def taxon_limits(spark, d):
    rows = curation.most_per_taxon(A.tax4(spark, d), [["r0", "r1"]], 50, F.col("id"))
    return curation.least_per_taxon(rows, [["r0", "r1"]], 45).select("id", "r0", "r1")


@query("F7_first_per_genome", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3")
def per_genome(spark, d):
    return curation.first_per_genome(A.table(spark, d, "orders"), "o_custkey", "o_orderkey", 3).select("o_orderkey", "o_custkey")


@query("F8_added_back", "SELECT p_partkey, p_name FROM part WHERE p_size > 40 OR contains(p_name, '1')")
def added_back(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return curation.added_back(p.where("p_size > 40"), p, "p_name", ["1"], "p_partkey").select("p_partkey", "p_name")


@query("F10_top_taxa", sql("tax4", "SELECT r1, count(*) AS n_rows, min(id) AS first_seen FROM tax4 GROUP BY r1 ORDER BY 2 DESC, 3 LIMIT 10"))
def top_taxa(spark, d):
    return curation.top_taxa(A.tax4(spark, d), "r1", "id", 10)


@query("F14_excluded_taxa", sql("tax4", "SELECT r1, count(*) AS n_rows FROM tax4 GROUP BY r1 HAVING count(*) BETWEEN 3 AND 100000 ORDER BY sha256(r1), r1"))
def excluded(spark, d):
    return curation.excluded_taxa(A.tax4(spark, d), "r1", 3, 100_000)


@query("F15_random_split", sql("tax4", "SELECT id, row_number() OVER (ORDER BY (id * 1103515245 + 12345) % 2147483648, id) <= (SELECT floor(count(*) * 0.2) FROM tax4) AS is_test FROM tax4"))
def split(spark, d):
    t = A.tax4(spark, d).select("id")
    test = curation.share_by_hash(t, "id", 0.2, down=True).withColumn("is_test", F.lit(True))
    return t.join(test, "id", "left").select("id", F.coalesce("is_test", F.lit(False)).alias("is_test"))


@query("F16_stratified", sql("tax4", """SELECT id, r1
FROM (SELECT *, row_number() OVER (PARTITION BY r1 ORDER BY (id * 1103515245 + 12350) % 2147483648, id) AS n, round(count(*) OVER (PARTITION BY r1) * 0.3) AS m
FROM tax4)
WHERE n <= m"""))
def stratified(spark, d):
    return curation.share_by_hash(A.tax4(spark, d), "id", 0.3, 5, ("r1",)).select("id", "r1")


@query("F17_F18_keep", sql("mined", """SELECT i, j,
  CASE WHEN rank = 0 AND (((i * 1000003 + j) % 2147483648) * 1103515245 + 12345) % 2147483648 + 0.5 >= 0.5 * 2147483648.0 THEN -2 ELSE rank END::BIGINT AS rank,
  round(greatest(0.1, least(1, pow(50 / sqrt((i % 97 + 1) * (j % 89 + 1)), 0.7))), 6) AS p FROM mined"""))
def keep(spark, d):
    m = A.mined(spark, d)
    cut = mining.dropped_by_rank(m, {0: 0.5}, F.col("i") * 1000003 + F.col("j"))
    return cut.select("i", "j", F.col("rank").cast("long").alias("rank"), F.round(S.keep_probability(F.col("i") % 97 + 1, F.col("j") % 89 + 1, F.lit(50.0), 0.7, 0.1), 6).alias("p"))


@query("G1_length_stats", sql("seqs", """SELECT coalesce(lang, 'All') AS lang, count(*) AS n_rows, min(length(dna))::BIGINT AS shortest, max(length(dna))::BIGINT AS longest,
  round(avg(length(dna)), 6) AS mean, round(stddev_samp(length(dna)), 6) AS std,
  round(quantile_cont(length(dna), 0.01), 6) AS p1,
  round(quantile_cont(length(dna), 0.1), 6) AS p10,
  round(quantile_cont(length(dna), 0.5), 6) AS median,
  round(quantile_cont(length(dna), 0.9), 6) AS p90,
  round(quantile_cont(length(dna), 0.99), 6) AS p99 FROM seqs GROUP BY ROLLUP (lang)"""))
def length_stats(spark, d):
    return curation.length_stats(A.seqs(spark, d), "dna", "lang")


@query("G3_W2_funnel", sql("seqs", """, s AS (SELECT lang, CASE WHEN length(dna) < 40 THEN 0 WHEN length(dna) > 600 THEN 1 WHEN lang = 'fr' THEN 2 ELSE 3 END AS step FROM seqs), g AS (SELECT 'All' AS grp, step FROM s UNION ALL SELECT lang, step FROM s),
k AS (SELECT DISTINCT grp, step, name FROM g AS x(grp, ignored), (VALUES (0, 'short'), (1, 'long'), (2, 'language')) y(step, name)),
c AS (SELECT k.grp, k.step, k.name, (SELECT count(*) FROM g WHERE g.grp = k.grp AND g.step = k.step) AS removed, (SELECT count(*) FROM g WHERE g.grp = k.grp AND g.step > k.step) AS remaining FROM k)
SELECT grp AS "group", step::BIGINT AS step, name, removed, remaining, round(100 * removed / nullif(removed + remaining, 0), 6) AS percent FROM c"""))
def funnel(spark, d):
    n = F.length("dna")
    return curation.funnel(A.seqs(spark, d), [("short", n >= 40), ("long", n <= 600), ("language", F.col("lang") != "fr")], "lang")


@query("G4_duplicate_depth", """WITH g AS (SELECT text, count(*) AS c, count(DISTINCT lang) AS l, count(DISTINCT source) AS s, count(DISTINCT doc_id % 3) AS m
FROM documents
GROUP BY text
HAVING count(*) > 1) SELECT CASE WHEN m = 1 THEN 'genome' WHEN s = 1 THEN 'source' WHEN l = 1 THEN 'lang' ELSE 'none' END AS rank, count(*) AS n_sequences, sum(c - 1)::BIGINT AS n_extra, max(length(text))::BIGINT AS longest
FROM g
GROUP BY 1""")
def duplicate_depth(spark, d):
    rows = A.table(spark, d, "documents").select("text", "lang", "source", (F.col("doc_id") % 3).alias("genome"))
    return curation.duplicate_depth(rows, "text", ["lang", "source"], "genome")


# Taxa


@query("D10_G7_taxon_ids", sql("tax4", """, t AS (SELECT DISTINCT 0 AS rank, r0 AS taxon
FROM tax4 UNION SELECT DISTINCT 1, r1
FROM tax4 UNION SELECT DISTINCT 2, r2
FROM tax4) SELECT rank::BIGINT AS rank, taxon, dense_rank() OVER (ORDER BY rank, taxon) - 1 AS taxon_id
FROM t"""))
def taxon_ids(spark, d):
    return taxonomy.taxon_ids(A.tax4(spark, d), ["r0", "r1", "r2"]).withColumn("rank", F.col("rank").cast("long"))


@query("G5_G9_taxon_sizes", sql("tax4", """, t AS (SELECT 0 AS rank, r0 AS taxon, count(*) AS n
FROM tax4
GROUP BY 2
UNION ALL SELECT 1, r1, count(*)
FROM tax4
GROUP BY 2
UNION ALL SELECT 2, r2, count(*)
FROM tax4
GROUP BY 2) SELECT rank::BIGINT AS rank, count(*) AS n_taxa, quantile_cont(n, 0.5)::DOUBLE AS median, round(avg(n), 6) AS mean
FROM t
GROUP BY rank"""))
def baselines(spark, d):
    return taxonomy.size_baselines(A.tax4(spark, d), "id", ["r0", "r1", "r2"]).withColumn("rank", F.col("rank").cast("long"))


@query("G6_children", sql("tax4", ", f AS (SELECT r0, r1, min(id) AS o FROM tax4 GROUP BY r0, r1) SELECT r0, string_agg(r1, ',' ORDER BY o, r1) AS children FROM f GROUP BY r0"))
def children(spark, d):
    return taxonomy.children(A.tax4(spark, d), "r0", "r1", "id").select("r0", F.array_join("children", ",").alias("children"))


@query("J8_homonyms", """SELECT x AS taxon, count(DISTINCT k) AS n_ranks
FROM (SELECT p_brand AS x, 0 AS k
FROM part
UNION ALL SELECT p_type, 1
FROM part
UNION ALL SELECT substr(p_brand, 1, 5), 2
FROM part
UNION ALL SELECT substr(p_type, 1, 5), 3
FROM part)
GROUP BY x
HAVING count(DISTINCT k) > 1""")
def homonyms(spark, d):
    p = A.table(spark, d, "part").withColumn("b5", F.substring("p_brand", 1, 5)).withColumn("t5", F.substring("p_type", 1, 5))
    return taxonomy.homonyms(p, "p_partkey", ["p_brand", "p_type", "b5", "t5"])


@query("J4_shared_rank", sql("tax4", """SELECT a.id AS i, b.id AS j, CASE WHEN a.r1 <> b.r1 THEN 0 WHEN a.r2 <> b.r2 THEN 1 ELSE 2 END::BIGINT AS shared_rank
FROM tax4 a JOIN tax4 b ON a.r0 = b.r0 AND a.id <> b.id WHERE a.id % 100 = 0"""))
def shared_rank(spark, d):
    t = A.tax4(spark, d)
    return taxonomy.shared_ranks(t.where("id % 100 = 0"), t, "id", ["r0", "r1", "r2"])


@query("J4_taxon_classes", sql("tax4", """SELECT id, min(id) OVER (PARTITION BY r0) || ',' || min(id) OVER (PARTITION BY r0, r1) || ',' || min(id) OVER (PARTITION BY r0, r1, r2) AS taxa FROM tax4"""))
def taxon_classes(spark, d):
    got = taxonomy.taxon_classes(A.tax4(spark, d), "id", ["r0", "r1", "r2"])
    return got.select("id", F.array_join(F.transform("taxa", lambda x: x.cast("string")), ",").alias("taxa"))


@query("G40_rank_histogram", sql("tax4", """SELECT CASE WHEN a.r0 <> b.r0 THEN -1 WHEN a.r1 <> b.r1 THEN 0 WHEN a.r2 <> b.r2 THEN 1 ELSE 2 END::BIGINT AS shared_rank, count(*) AS n_pairs
FROM tax4 a JOIN tax4 b ON a.id < b.id
GROUP BY 1"""))
def rank_histogram(spark, d):
    return taxonomy.shared_rank_counts(A.tax4(spark, d), ["r0", "r1", "r2"])


@query("J6_tree_distance", sql("tax4", """SELECT a.id AS i, b.id AS j, CASE WHEN a.r1 = b.r1 THEN 0.3 WHEN a.r0 = b.r0 THEN 0.6 ELSE 0.9 END::DOUBLE AS distance
FROM tax4 a JOIN tax4 b ON a.id <> b.id WHERE a.id % 100 = 0"""))
def tree(spark, d):
    c = A.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.lit(0.0).alias("dist"))
    n = A.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit(0.3).alias("dist"))
    r = A.table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("root").alias("parent"), F.lit(0.6).alias("dist"))
    top = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.9).alias("dist"))
    leaves = c.select(F.col("node").alias("leaf"), F.substring("node", 2, 20).try_cast("long").alias("id"))
    return trees.distances(leaves.where("id % 100 = 0"), leaves, c.unionByName(n).unionByName(r).unionByName(top), 1.65)


# k-mers


@query("K1_kmers", sql("seqs", "SELECT doc_id, kmer, count(*) AS n FROM (SELECT doc_id, substr(dna, unnest(generate_series(1, length(dna) - 3)), 4) AS kmer FROM seqs) GROUP BY ALL"))
def kmer_counts(spark, d):
    return kmers.kmer_counts(A.seqs(spark, d), "doc_id", "dna", 4).drop("kmer_idx")


@query("S10_G56_kmer_moments", sql("seqs", """, c AS (SELECT doc_id, kmer, count(*) AS n
FROM (SELECT doc_id, substr(dna, unnest(generate_series(1, length(dna) - 3)), 4) AS kmer
FROM seqs)
GROUP BY ALL),
t AS (SELECT count(*)::DOUBLE AS m
FROM seqs) SELECT kmer, list_sum(list_transform(generate_series(1, 4), lambda k: (strpos('ACGT', kmer[k]) - 1) * pow(4, 4 - k)))::BIGINT AS kmer_idx, round(sum(n) / max(m), 6) AS mean, round(sqrt(greatest(0, sum(n * n) / max(m) - pow(sum(n) / max(m), 2))), 6) AS std
FROM c, t
GROUP BY kmer"""))
def kmer_moments(spark, d):
    rows = A.seqs(spark, d)
    return kmers.kmer_moments(kmers.kmer_counts(rows, "doc_id", "dna", 4), None, rows.agg(F.count("*").alias("n")))


@query("K3_K7_truncated", sql("seqs", """, h AS (SELECT *, ((doc_id * 1103515245 + 12345) % 2147483648 % 11) AS s, ((doc_id * 1103515245 + 12346) % 2147483648 % 11) AS e
FROM seqs
WHERE length(dna) > 0),
f AS (SELECT *, least(s, length(dna) - 1) AS b
FROM h) SELECT doc_id, substr(dna, b + 1, greatest(1, length(dna) - b - e)) AS cut
FROM f"""))
def truncation(spark, d):
    return A.seqs(spark, d).where("length(dna) > 0").select("doc_id", S.truncated(F.col("dna"), F.col("doc_id"), 10, 10).alias("cut"))


@query("K4_mutated", sql("seqs", """SELECT doc_id, list_aggregate(list_transform(string_split(dna, ''), lambda c, i: CASE WHEN (((doc_id * 8191 + i - 1) % 2147483648) * 1103515245 + 12345) % 2147483648 + 0.5 < 0.05 * 2147483648.0
  THEN xor(strpos('ACGT', c) - 1, 1 + (((doc_id * 8191 + i - 1) % 2147483648) * 1103515245 + 12346) % 2147483648 % 3) ELSE strpos('ACGT', c) - 1 END), 'string_agg', '') AS codes FROM seqs WHERE length(dna) > 0"""))
def mutation(spark, d):
    codes = S.base_codes(F.col("dna"))
    return A.seqs(spark, d).where("length(dna) > 0").select("doc_id", F.array_join(S.mutated(codes, F.col("doc_id"), 0.05), "").alias("codes"))


# Neighbours


def _sides(spark, d):
    """The query set, every row whose id is divisible by 100, and all rows."""
    v = A.vecs(spark, d)
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("v").alias("qv"), "r0", "r1"), v.select(F.col("vec_id").alias("b"), F.col("v").alias("bv"), "r0", "r1")


_MET = "vecs q JOIN vecs b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id"


@query("J13_G13_knn_classification", sql("vecs", f""", s AS (SELECT q.vec_id AS q, q.r1 AS t, b.r1 AS p, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_dot_product(q.v, b.v), 9), b.vec_id) AS n FROM {_MET})
SELECT t AS true_label, count(*) AS n_valid, round(avg((t = p)::INT), 6) AS accuracy FROM s WHERE n = 1 GROUP BY t"""))
def knn_classification(spark, d):
    q, b = _sides(spark, d)
    near = neighbours.nearest(q.select("q", "qv"), b.select("b", "bv"), exclude_self=True)
    rows = near.join(q.select("q", F.col("r1").alias("true")), "q").join(b.select("b", F.col("r1").alias("pred")), "b")
    return evaluation.accuracy(rows.withColumn("true_label", F.col("true")), ["true_label"])


@query("J13_W9_euclidean", sql("vecs", f"""SELECT q, b, d FROM (SELECT q.vec_id AS q, b.vec_id AS b, round(list_distance(q.v, b.v) ** 2, 6) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, b.v) ** 2, 9), b.vec_id) AS place FROM {_MET}) WHERE place = 1"""))
def nearest_euclidean(spark, d):
    q, b = _sides(spark, d)
    return neighbours.nearest(q.select("q", "qv"), b.select("b", "bv"), 1, "squared", exclude_self=True).select("q", "b", F.round("d", 6).alias("d"))


@query("J13_W8_neighbours", sql("vecs", """SELECT *
FROM (SELECT q.vec_id AS q, b.vec_id AS b, round(1 - list_dot_product(q.v, b.v), 6) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_dot_product(q.v, b.v), 9), b.vec_id) AS place
FROM vecs q JOIN vecs b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id)
WHERE place <= 5"""))
def neighbours_of_all(spark, d):
    v = A.vecs(spark, d)
    q, b = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("v").alias("qv")), v.select(F.col("vec_id").alias("b"), F.col("v").alias("bv"))
    return neighbours.nearest(q, b, 5, exclude_self=True).select("q", "b", F.round("d", 6).alias("d"), F.col("place").cast("long").alias("place"))


@query("J13_W8_indexed", ORACLE_SQL["J13_W8_neighbours"])
def indexed(spark, d):
    q, b = _sides(spark, d)
    found = vector_index.search(q.select("q", "qv"), vector_index.build(b.select("b", "bv"), 64), 5, exclude_self=True)
    return found.select("q", "b", F.round("d", 6).alias("d"), F.col("place").cast("long").alias("place"))


@query("J13_K1_sparse_neighbours", sql("seqs", """, k AS (SELECT doc_id, substr(dna, unnest(generate_series(1, length(dna) - 6)), 7) AS kmer FROM seqs), c AS (SELECT doc_id, kmer, count(*)::DOUBLE AS n FROM k GROUP BY ALL),
m AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id), q AS (SELECT * FROM c WHERE doc_id % 100 = 0),
p AS (SELECT q.doc_id AS q, b.doc_id AS b, sum(q.n * b.n) AS dot FROM q JOIN c b USING (kmer) WHERE q.doc_id <> b.doc_id GROUP BY ALL),
s AS (SELECT q, b, round(1 - dot / x.norm / y.norm, 6) AS d, row_number() OVER (PARTITION BY q ORDER BY round(1 - dot / x.norm / y.norm, 6), b) AS place FROM p JOIN m x ON x.doc_id = q JOIN m y ON y.doc_id = b)
SELECT q, d, place FROM s WHERE place <= 3"""))
def sparse_neighbours(spark, d):
    v = sparse.unit_vectors(kmers.kmer_counts(A.seqs(spark, d), "doc_id", "dna", 7), "doc_id")
    v = written(v, "sparse")
    got = sparse.nearest(v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("q"), "at", "x"), v.select(F.col("doc_id").alias("b"), "at", "x"), 3, exclude_self=True)
    return got.where("d < 1").select("q", F.round("d", 6).alias("d"), F.col("place").cast("long").alias("place"))


@query("G10_J14_hierarchical", sql("vecs", f""", s AS (SELECT q.vec_id AS q, b.vec_id AS b, b.r0, b.r1, round(1 - list_dot_product(q.v, b.v), 9) AS d FROM {_MET}),
z0 AS (SELECT r0, count(*) AS size FROM vecs GROUP BY r0), z1 AS (SELECT r0, r1, count(*) AS size FROM vecs GROUP BY r0, r1),
n0 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, b) AS n FROM s), v0 AS (SELECT q, r0, round(sum(1 / sqrt(size) / (d * d + 0.000001)), 6) AS v, max(size) AS size FROM n0 JOIN z0 USING (r0) WHERE n <= 75 GROUP BY q, r0),
w0 AS (SELECT q, r0, v / sum(v) OVER (PARTITION BY q) AS c, row_number() OVER (PARTITION BY q ORDER BY v DESC, size DESC, r0 DESC) AS n FROM v0),
n1 AS (SELECT s.*, row_number() OVER (PARTITION BY s.q ORDER BY d, b) AS n FROM s JOIN w0 ON s.q = w0.q AND s.r0 = w0.r0 AND w0.n = 1),
v1 AS (SELECT q, r0, r1, round(sum(1 / sqrt(size) / (d * d + 0.000001)), 6) AS v, max(size) AS size FROM n1 JOIN z1 USING (r0, r1) WHERE n <= 50 GROUP BY q, r0, r1),
w1 AS (SELECT q, r1, v / sum(v) OVER (PARTITION BY q) AS c, row_number() OVER (PARTITION BY q ORDER BY v DESC, size DESC, r1 DESC) AS n FROM v1)
SELECT w0.q, w0.r0 AS p_r0, w1.r1 AS p_r1, round(w0.c, 6) AS c_r0, round(w0.c * w1.c, 6) AS c_r1 FROM w0 JOIN w1 USING (q) WHERE w0.n = 1 AND w1.n = 1"""))
def hierarchical(spark, d):
    q, b = _sides(spark, d)
    return neighbours.hierarchical(q.select("q", "qv"), b, ["r0", "r1"], [75, 50], exclude_self=True)


@query("G11_centroids", sql("vecs", """, e AS (SELECT r1, unnest(v) AS x, generate_subscripts(v, 1) AS k
FROM vecs),
s AS (SELECT r1, k, sum(x) AS s, count(*) AS n
FROM e
GROUP BY r1, k) SELECT r1, max(n) AS n, round(sqrt(sum(s * s)) / max(n), 5) AS resultant
FROM s
GROUP BY r1"""))
def centroids(spark, d):
    return neighbours.centroids(A.vecs(spark, d), ["r1"], "v").select("r1", "n", F.round("resultant", 5).alias("resultant"))


@query("G12_S23_prototypes", sql("vecs", """, u AS (SELECT vec_id, r1, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 0.00000001)) AS v FROM vecs),
e AS (SELECT r1, k, sum(x) AS s FROM (SELECT r1, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM u) GROUP BY r1, k), c AS (SELECT r1, list(s ORDER BY k) AS s FROM e GROUP BY r1),
p AS (SELECT r1, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS c FROM c),
m AS (SELECT vec_id AS q, p.r1, round(list_dot_product(v, c), 9) AS sim FROM u JOIN p ON vec_id % 100 = 0), t AS (SELECT *, max(sim) OVER (PARTITION BY q) AS most, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r1) AS n FROM m)
SELECT q, max(CASE WHEN n = 1 THEN r1 END) AS predicted, round(1 / sum(exp((sim - most) / 0.02)), 5) AS confidence FROM t GROUP BY q"""))
def prototypes(spark, d):
    q, b = _sides(spark, d)
    got = neighbours.prototype_classes(q.select("q", "qv"), neighbours.centroids(b, ["r1"], "bv"), "r1")
    return got.select("q", "predicted", F.round("confidence", 5).alias("confidence"))


# Classification at all seven ranks

_RANKS = [f"t{k}" for k in range(7)]
#: Taxa of a vector: names under their parent's, so that a name has one path.
_TAXA = ["label % 2", "label", "vec_id % 3", "vec_id % 2", "vec_id // 6 % 2", "vec_id // 12 % 2", "vec_id // 24 % 3"]
_K_BY_RANK = [75, 50, 10, 10, 7, 5, 3]
_SEVEN = "seven AS (SELECT vec_id, 'R' || vec_id % 4 AS region, list_transform(embedding, lambda x: x::DOUBLE) AS v, " + ", ".join(
    " || '.' || ".join(f"({e})::BIGINT::VARCHAR" for e in _TAXA[: k + 1]) + f" AS t{k}" for k in range(7)
) + " FROM embeddings)"


def _seven(spark, d) -> tuple[DataFrame, DataFrame]:
    """The query set, every row whose id is divisible by 100, and all rows with seven ranks and a region."""
    v = A.table(spark, d, "embeddings")
    parts = [F.expr(e.replace("//", "div")).cast("long").cast("string") for e in _TAXA]
    rows = v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("bv"), F.concat(F.lit("R"), (F.col("vec_id") % 4).cast("string")).alias("region"), *[F.concat_ws(".", *parts[: k + 1]).alias(f"t{k}") for k in range(7)])
    return rows.where("b % 100 = 0").select(F.col("b").alias("q"), F.col("bv").alias("qv")), rows


def _voted_sql() -> str:
    steps = ["WITH " + _SEVEN, "s AS (SELECT q.vec_id AS q, b.*, round(1 - list_dot_product(q.v, b.v), 9) AS d FROM seven q JOIN seven b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id)"]
    for r, k in enumerate(_K_BY_RANK):
        inside = f" JOIN w{r - 1} w ON s.q = w.q AND s.t{r - 1} = w.taxon AND w.n = 1" if r else ""
        steps.append(f"n{r} AS (SELECT s.*, row_number() OVER (PARTITION BY s.q ORDER BY d, vec_id) AS n FROM s{inside})")
        steps.append(f"""v{r} AS (SELECT q, t{r} AS taxon, round(sum(1 / sqrt(size) / (d * d + 0.000001)), 6) AS v, max(size) AS size, arg_min(region, (d, vec_id)) AS region
FROM n{r} JOIN (SELECT t{r}, count(*) AS size FROM seven GROUP BY t{r}) USING (t{r}) WHERE n <= {k} GROUP BY q, t{r})""")
        steps.append(f"w{r} AS (SELECT *, v / sum(v) OVER (PARTITION BY q) AS c, row_number() OVER (PARTITION BY q ORDER BY v DESC, size DESC, taxon DESC) AS n FROM v{r})")
    cols = [f"w{r}.taxon AS p_t{r}, round({' * '.join(f'w{j}.c' for j in range(r + 1))}, 6) AS c_t{r}" for r in range(7)]
    return ",\n".join(steps) + f"\nSELECT w0.q, {', '.join(cols)}, w0.region AS best_region FROM w0 " + " ".join(f"JOIN w{r} ON w{r}.q = w0.q AND w{r}.n = 1" for r in range(1, 7)) + " WHERE w0.n = 1"


def _prototype_sql(size_alpha: int, quality_alpha: int) -> str:
    steps = ["WITH " + _SEVEN, "u AS (SELECT * REPLACE (list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 0.00000001)) AS v) FROM seven)"]
    for r in range(7):
        above = f"t{r - 1}" if r else "0 AS t"
        inside = f" JOIN w{r - 1} w ON u.vec_id = w.q AND w.n = 1 JOIN p{r} p ON p.above = w.taxon" if r else " JOIN p0 p ON TRUE"
        steps.append(f"""e{r} AS (SELECT {above.split()[0]} AS above, taxon, list(s ORDER BY k) AS s, max(n) AS n FROM (SELECT {above}, t{r} AS taxon, k, sum(x) AS s, count(*) AS n
FROM (SELECT *, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM u) GROUP BY ALL) GROUP BY ALL)""")
        steps.append(f"""p{r} AS (SELECT above, taxon, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS c, n / (n + {size_alpha}) * sqrt(list_dot_product(s, s)) / (n + {quality_alpha}) AS f FROM e{r})""")
        steps.append(f"m{r} AS (SELECT u.vec_id AS q, p.taxon, round(list_dot_product(u.v, p.c) * p.f, 9) AS sim FROM u{inside} WHERE u.vec_id % 100 = 0)")
        steps.append(f"""w{r} AS (SELECT q, taxon, 1 / sum(exp((sim - most) / 0.02)) OVER (PARTITION BY q) AS c, n
FROM (SELECT *, max(sim) OVER (PARTITION BY q) AS most, row_number() OVER (PARTITION BY q ORDER BY sim DESC, taxon) AS n FROM m{r}))""")
    steps.append("""near AS (SELECT w6.q, arg_min(b.region, (round(1 - list_dot_product(a.v, b.v), 9), b.vec_id)) AS best_region
FROM w6 JOIN seven a ON a.vec_id = w6.q JOIN seven b ON b.t6 = w6.taxon WHERE w6.n = 1 GROUP BY w6.q)""")
    cols = [f"w{r}.taxon AS p_t{r}, round({' * '.join(f'w{j}.c' for j in range(r + 1))}, 6) AS c_t{r}" for r in range(7)]
    return ",\n".join(steps) + f"\nSELECT near.q, {', '.join(cols)}, best_region FROM near " + " ".join(f"JOIN w{r} ON w{r}.q = near.q AND w{r}.n = 1" for r in range(7))


@query("G10_J14_seven_ranks", _voted_sql())
def seven_voted(spark, d):
    q, b = _seven(spark, d)
    return neighbours.hierarchical(q, b, _RANKS, _K_BY_RANK, exclude_self=True, region="region")


@query("G12_seven_ranks", _prototype_sql(1, 1))
def seven_prototypes(spark, d):
    q, b = _seven(spark, d)
    return classification.prototype_hierarchy(q, b, _RANKS, size_alpha=1.0, quality_alpha=1.0, region="region")


# Evaluation

_RIGHT = "(true_ = pred)::INT"


@query("G14_accuracy", sql("preds", f"SELECT region, count(*) AS n_valid, round(avg({_RIGHT}), 6) AS accuracy FROM preds WHERE pred <> '' GROUP BY region"))
def accuracy(spark, d):
    p = A.preds(spark, d)
    return evaluation.accuracy(p.where(evaluation.valid(F.col("pred"), F.lit(True))), ["region"])


@query("G15_macro_accuracy", sql("preds", f", t AS (SELECT region, true_, avg({_RIGHT}) AS a FROM preds WHERE pred <> '' GROUP BY ALL) SELECT region, count(*) AS n_taxa, round(avg(a), 6) AS macro_accuracy FROM t GROUP BY region"))
def macro(spark, d):
    return evaluation.macro_accuracy(A.preds(spark, d).where("pred <> ''"), ["region"])


@query("G16_deepest_correct", sql("preds", """, n AS (SELECT CASE WHEN pred <> true_ THEN 0 WHEN status <> 'O' THEN 1 ELSE 2 END AS depth
FROM preds) SELECT depth::BIGINT AS depth, count(*) AS n_rows
FROM n
GROUP BY depth"""))
def deepest(spark, d):
    p = A.preds(spark, d)
    depth = evaluation.deepest_correct(F.array("true", "status"), F.array("pred", F.lit("O")))
    return p.groupBy(depth.cast("long").alias("depth")).agg(F.count("*").alias("n_rows"))


@query("G17_region_counts", "SELECT l_linenumber::BIGINT AS region, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_seqs FROM lineitem GROUP BY 1")
def region_counts(spark, d):
    return A.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("region")).agg(F.count("*").alias("n_rows"), F.countDistinct("l_orderkey").alias("n_seqs"))


@query("G20_confidence_spread", sql("preds", """SELECT true_ = pred AS correct, count(*) AS n_rows, min(conf) AS least, max(conf) AS most,
  round(quantile_cont(conf, 0.05), 6) AS p5,
  round(quantile_cont(conf, 0.25), 6) AS p25,
  round(quantile_cont(conf, 0.5), 6) AS median,
  round(quantile_cont(conf, 0.75), 6) AS p75,
  round(quantile_cont(conf, 0.95), 6) AS p95
FROM preds
GROUP BY 1"""))
def spread(spark, d):
    return evaluation.confidence_spread(A.preds(spark, d).withColumn("correct", F.col("true") == F.col("pred")), ["correct"], "conf")


@query("G21_calibration", sql("preds", """, b AS (SELECT region, least(floor(conf * 10), 9)::BIGINT AS bin, conf, true_ = pred AS ok
FROM preds) SELECT region, bin, count(*) AS n_rows, round(avg(conf), 6) AS mean_conf, round(avg(ok::INT), 6) AS accuracy
FROM b
GROUP BY region, bin
HAVING count(*) >= 10"""))
def calibration(spark, d):
    return evaluation.calibration_width(A.preds(spark, d).withColumn("ok", F.col("true") == F.col("pred")), ["region"], "conf", "ok")


@query("G21_W12_equal_counts", sql("preds", """, b AS (SELECT region, ntile(100) OVER (PARTITION BY region ORDER BY conf, id) AS chunk, conf, true_ = pred AS ok
FROM preds) SELECT region, chunk, count(*) AS n_rows, min(conf) AS low, max(conf) AS high, round(avg(conf), 6) AS mean_conf, round(avg(ok::INT), 6) AS accuracy
FROM b
GROUP BY region, chunk"""))
def equal_counts(spark, d):
    return evaluation.calibration_count(A.preds(spark, d).withColumn("ok", F.col("true") == F.col("pred")), ["region"], "conf", "ok", "id")


@query("G22_W13_correlation", sql("preds", """, r AS (SELECT region, conf, (true_ = pred)::DOUBLE AS ok,
  rank() OVER (PARTITION BY region ORDER BY conf) + (count(*) OVER (PARTITION BY region, conf) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY region ORDER BY true_ = pred) + (count(*) OVER (PARTITION BY region, true_ = pred) - 1) / 2.0 AS b
FROM preds) SELECT region, count(*) AS n_rows, round(corr(conf, ok), 6) AS pearson, round(corr(a, b), 6) AS spearman
FROM r
GROUP BY region"""))
def correlation(spark, d):
    return evaluation.correlations(A.preds(spark, d).withColumn("ok", (F.col("true") == F.col("pred")).cast("double")), ["region"], "conf", "ok")


@query("G23_confusions", sql("preds", """, w AS (SELECT true_, pred, count(*) AS n
FROM preds
WHERE true_ <> pred
GROUP BY ALL) SELECT true_ AS "true", pred, n AS n_rows, round(n / (SELECT sum(n)
FROM w), 6) AS share
FROM w
ORDER BY n DESC, 1, 2 LIMIT 20"""))
def confusion(spark, d):
    return evaluation.confusions(A.preds(spark, d), 20)


@query("G25_taxon_scores", sql("preds", """, t AS (SELECT region, true_ AS taxon, count(*) AS n_true, sum((true_ = pred)::INT) AS hit
FROM preds
GROUP BY ALL),
p AS (SELECT region, pred AS taxon, count(*) AS n_pred
FROM preds
WHERE pred <> ''
GROUP BY ALL) SELECT region, taxon, n_true, coalesce(n_pred, 0) AS n_pred, round(hit / n_true, 6) AS recall, round(hit / n_pred, 6) AS precision, round(2 * (hit / n_true) * (hit / n_pred) / (hit / n_true + hit / n_pred), 6) AS f1
FROM t
LEFT JOIN p USING (region, taxon)"""))
def taxon_scores(spark, d):
    return evaluation.taxon_scores(A.preds(spark, d), ["region"])


@query("G26_J17_absent", """SELECT n_name, n AS n_rows
FROM (SELECT n_name, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name)
WHERE n_name NOT IN (SELECT n_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE s_acctbal > 8000)""")
def absence(spark, d):
    n = A.table(spark, d, "nation")
    c = A.table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    s = A.table(spark, d, "supplier").where("s_acctbal > 8000").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return evaluation.absent(c, s, "n_name")


_TABLE = """, c AS (SELECT true_ AS l, pred AS k, count(*)::DOUBLE AS n
FROM preds
GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY l) AS a, sum(n) OVER (PARTITION BY k) AS b, sum(n) OVER () AS m
FROM c)"""


@query("G28_G29_agreement", sql("preds", _TABLE + """, la AS (SELECT DISTINCT l, a, m FROM t),
  kb AS (SELECT DISTINCT k, b, m FROM t),
  x AS (SELECT (SELECT sum(-a / m * ln(a / m)) FROM la) AS hc,
  (SELECT sum(-b / m * ln(b / m)) FROM kb) AS hk,
  (SELECT sum(a * (a - 1) / 2) FROM la) AS pa,
  (SELECT sum(b * (b - 1) / 2) FROM kb) AS pb, sum(-n / m * ln(n / b)) AS hck, sum(-n / m * ln(n / a)) AS hkc, sum(n * (n - 1) / 2) AS pn, max(m) AS m FROM t),
y AS (SELECT 1 - hck / hc AS h, 1 - hkc / hk AS c, pa * pb / (m * (m - 1) / 2) AS e, * FROM x) SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v_measure, round((pn - e) / ((pa + pb) / 2 - e), 6) AS adjusted_rand FROM y"""))
def agreement(spark, d):
    return evaluation.agreement(A.preds(spark, d), "true", "pred")


@query("G30_adjusted_mutual_information")
def ami(spark, d):
    return evaluation.adjusted_mutual_information(A.vecs(spark, d), "r1", "r2")


@query("G31_dominant_cluster", sql("vecs", """, c AS (SELECT r1 AS l, r2 AS k, count(*) AS n
FROM vecs
GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY l) AS a, sum(n) OVER (PARTITION BY k) AS b, row_number() OVER (PARTITION BY l ORDER BY n DESC, k) AS o
FROM c) SELECT l AS label, k AS cluster, round(n / b, 6) AS precision, round(n / a, 6) AS recall, round(2 * (n / b) * (n / a) / (n / b + n / a + 0.000000001), 6) AS f1
FROM t
WHERE o = 1"""))
def dominant(spark, d):
    return evaluation.dominant_clusters(A.vecs(spark, d), "r1", "r2")


@query("G32_contingency", sql("preds", _TABLE + " SELECT l AS label, k AS cluster, n::BIGINT AS n, a::BIGINT AS a, b::BIGINT AS b, m::BIGINT AS total FROM t"))
def contingency(spark, d):
    return evaluation.contingency(A.preds(spark, d), "true", "pred")


@query("G34_congruency", sql("vecs", """, w AS (SELECT r1 AS item, vec_id % 2 AS side, v
FROM vecs),
p AS (SELECT a.r1 AS item, avg(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS w
FROM vecs a JOIN vecs b ON a.r1 = b.r1 AND a.vec_id < b.vec_id
GROUP BY a.r1),
o AS (SELECT avg(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS other
FROM w a JOIN w b ON a.side = 0 AND b.side = 1),
s AS (SELECT avg(w) AS same
FROM p) SELECT round(same, 6) AS same, round(other, 6) AS other, round((other - same) / (other + 0.00001), 6) AS ssc
FROM s, o"""))
def congruency(spark, d):
    return evaluation.congruency(A.vecs(spark, d).withColumn("side", F.col("vec_id") % 2), "r1", "v", "side")


@query("G35_G36_best_k", sql("history", """, r AS (SELECT rank, bucket, count(DISTINCT batch) AS n_runs, round(avg(loss), 6) AS mean
FROM history
GROUP BY ALL) SELECT rank, bucket AS best_k, mean AS best_mean
FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY mean DESC, bucket) AS n
FROM r)
WHERE n = 1"""))
def best_k(spark, d):
    return evaluation.best_k(evaluation.run_scores(A.history(spark, d), ["rank", "bucket"], "batch", "loss"), ["rank"], "bucket", "mean")


@query("C1_C2_first_round", sql("vecs", """, u AS (SELECT vec_id, r1, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 0.00000001)) AS v FROM vecs),
e AS (SELECT r1, k, avg(x) AS s FROM (SELECT r1, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM u) GROUP BY r1, k), c AS (SELECT dense_rank() OVER (ORDER BY r1) - 1 AS k, s FROM (SELECT r1, list(s ORDER BY k) AS s FROM e GROUP BY r1)),
a AS (SELECT vec_id, v, arg_min(k, (-sim, k)) AS k FROM (SELECT vec_id, v, k, list_dot_product(v, s) / sqrt(list_dot_product(s, s)) AS sim FROM u, c) GROUP BY vec_id, v),
f AS (SELECT k, p, sum(x) AS s FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a) GROUP BY k, p), n AS (SELECT k, list(s ORDER BY p) AS s FROM f GROUP BY k),
m AS (SELECT c.k, coalesce(n.s, c.s) AS s FROM c LEFT JOIN n USING (k))
SELECT vec_id, arg_min(k, (-sim, k))::BIGINT AS cluster FROM (SELECT vec_id, k, list_dot_product(v, s) / sqrt(list_dot_product(s, s)) AS sim FROM u, m) GROUP BY vec_id"""))
def first_round(spark, d):
    return clustering.kmeans(A.vecs(spark, d), "vec_id", "v", "r1", rounds=1)


@query("C1_C2_spherical_kmeans")
def spherical(spark, d):
    return clustering.kmeans(A.vecs(spark, d), "vec_id", "v", "r1")


@query("C3_euclidean_kmeans")
def euclidean(spark, d):
    return clustering.kmeans(A.vecs(spark, d), "vec_id", "v", "r1", spherical=False)


@query("C7_projection")
def projected(spark, d):
    return clustering.projection(A.vecs(spark, d), "vec_id", "v").select("vec_id", F.round("x0", 5).alias("x0"), F.round("x1", 5).alias("x1"))


# Mining


@query("G37_hardness", sql("mined", """SELECT rank::BIGINT AS rank, count(*) AS n_pairs, round(2 * avg(err) + quantile_cont(err, 0.25) + quantile_cont(err, 0.75), 6) AS hardness
FROM mined
GROUP BY rank"""))
def hardness(spark, d):
    return mining.pair_hardness(A.mined(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("G39_W4_buckets", sql("mined", """, c AS (SELECT rank, quantile_cont(err, 0.5) AS c1, quantile_cont(err, 0.75) AS c2, quantile_cont(err, 0.9) AS c3
FROM mined
GROUP BY rank) SELECT rank::BIGINT AS rank, ((err >= c1)::INT + (err >= c2)::INT + (err >= c3)::INT)::BIGINT AS bucket, count(*) AS n_rows
FROM mined JOIN c USING (rank)
GROUP BY 1, 2"""))
def buckets(spark, d):
    m = A.mined(spark, d)
    got = mining.bucketed(m, mining.thresholds(m, [0.5, 0.25, 0.15, 0.1]))
    return got.groupBy(F.col("rank").cast("long").alias("rank"), F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("n_rows"))


@query("S18_W5_representatives", sql("mined", """, g AS (SELECT *, i * 1000003 + j AS k
FROM mined),
u AS (SELECT *, round(-ln(-ln((((k % 2147483648) * 1103515245 + 12345) % 2147483648 + 0.5) / 2147483648.0)), 9) AS g
FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY g DESC, k) AS n
FROM u) SELECT rank::BIGINT AS rank, count(*) AS n_rows, sum(i)::BIGINT AS i_sum
FROM n
WHERE n <= 200
GROUP BY rank"""))
def representatives(spark, d):
    got = mining.representatives(A.mined(spark, d), F.col("i") * 1000003 + F.col("j"), 200)
    return got.groupBy(F.col("rank").cast("long").alias("rank")).agg(F.count("*").alias("n_rows"), F.sum("i").alias("i_sum"))


@query("M3_W6_W7_mined_pairs")
def mined_pairs(spark, d):
    got, _ = mining.mine_pairs(A.mined(spark, d), 40_000, 3_840, beta=0.5)
    return got.select("i", "j", F.col("rank").cast("long").alias("rank"), F.col("bucket").cast("long").alias("bucket"), F.round("err", 6).alias("err"))


@query("G38_moving_average", sql("mined", """, h AS (SELECT rank, round(2 * avg(err) + quantile_cont(err, 0.25) + quantile_cont(err, 0.75), 6) AS h
FROM mined
WHERE rank < 5
GROUP BY rank) SELECT r::BIGINT AS rank, round(CASE WHEN h IS NULL THEN 1.0 ELSE 0.95 + 0.05 * h END, 6) AS ema
FROM range(9) t(r)
LEFT JOIN h ON h.rank = r"""))
def moving(spark, d):
    state = spark.range(9).select(F.col("id").cast("int").alias("rank"), F.lit(1.0).alias("ema"))
    got = mining.moving_average(state, mining.pair_hardness(A.mined(spark, d).where("rank < 5")))
    return got.select(F.col("rank").cast("long").alias("rank"), F.round("ema", 6).alias("ema"))


@query("J10_triplet_candidates", sql("mined", """, e AS (SELECT DISTINCT a, rank + 1 AS r
FROM (SELECT i AS a, rank
FROM mined
UNION ALL SELECT j, rank
FROM mined)) SELECT i AS anchor, j AS positive, e.r::BIGINT AS rank
FROM mined JOIN e ON e.a = mined.i AND e.r BETWEEN 1 AND 3 AND mined.rank >= e.r"""))
def candidates(spark, d):
    return mining.triplet_candidates(A.mined(spark, d), [1, 2, 3]).withColumn("rank", F.col("rank").cast("long"))


@query("J11_J12_negatives", sql("mined", """, b AS (SELECT i AS a, j AS n, rank + 1 AS r, pred
FROM mined
UNION ALL SELECT j, i, rank + 1, pred
FROM mined),
g AS (SELECT a, r, n, round(-2 * pred - ln(-ln((((((a * 100003 + n * 17 + 7919) % 2147483648) * 1103515245 + 12345) % 2147483648) + 0.5) / 2147483648.0)), 9) AS g
FROM b) SELECT a AS anchor, r::BIGINT AS rank, n AS negative
FROM (SELECT *, row_number() OVER (PARTITION BY a, r ORDER BY g DESC, n DESC) AS o
FROM g)
WHERE o = 1"""))
def drawn_negatives(spark, d):
    return mining.negatives(A.mined(spark, d), 2.0).select("anchor", F.col("rank").cast("long").alias("rank"), "negative")


def _triplets(spark, d) -> DataFrame:
    over = F.round(F.col("pred") - F.col("true") + 0.1, 9)
    key = (F.col("i") * 10 + F.col("rank")).alias("triplet")
    return A.mined(spark, d).select(key, F.col("rank").cast("long").alias("rank"), F.col("pred").alias("ap"), F.col("true").alias("an"), F.lit(0.1).alias("margin"), over.alias("violation"), over.alias("nv"))


@query("F20_zero_loss", sql("mined", """, t AS (SELECT i * 10 + rank AS triplet, rank, round(pred - true_ + 0.1, 9) AS v
FROM mined),
n AS (SELECT *, row_number() OVER (PARTITION BY rank, v > 0 ORDER BY v DESC, triplet) AS n, sum((v > 0)::INT) OVER (PARTITION BY rank) AS k
FROM t) SELECT triplet, rank::BIGINT AS rank
FROM n
WHERE v > 0 OR n <= CASE WHEN rank = 6 THEN 4000 ELSE 0 END - k"""))
def zero_loss(spark, d):
    return mining.zero_loss_filter(_triplets(spark, d), {6: 4000}).select("triplet", "rank")


@query("G41_endpoints", sql("mined", "SELECT x % 7 AS grp, count(*) AS n_ends FROM (SELECT i AS x FROM mined UNION ALL SELECT j FROM mined) GROUP BY 1"))
def endpoints(spark, d):
    m = A.mined(spark, d)
    groups = m.select("i").union(m.select("j")).distinct().select(F.col("i").alias("id"), (F.col("i") % 7).alias("grp"))
    return mining.endpoint_counts(m, groups)


@query("W15_batches", sql("preds", "SELECT batch, count(*) AS n_rows FROM (SELECT floor((row_number() OVER (ORDER BY event_id) - 1) / 256)::BIGINT AS batch FROM events) GROUP BY batch"))
def batches(spark, d):
    return mining.in_batches(A.history(spark, d), "event_id", 256).groupBy("batch").agg(F.count("*").alias("n_rows"))


# Logs and histories


@query("G42_loss_stats", sql("history", """SELECT coalesce(r, 'All') AS rank, coalesce(b, 'All') AS bucket, count(*) AS n_rows, round(min(loss), 6) AS least,
  round(quantile_cont(loss, 0.05), 6) AS p5,
  round(quantile_cont(loss, 0.25), 6) AS p25,
  round(quantile_cont(loss, 0.5), 6) AS median,
  round(quantile_cont(loss, 0.75), 6) AS p75,
  round(quantile_cont(loss, 0.95), 6) AS p95, round(max(loss), 6) AS most, round(avg(loss), 6) AS mean, round(stddev_samp(loss), 6) AS std
FROM (SELECT rank AS r, bucket::VARCHAR AS b, loss FROM history) GROUP BY GROUPING SETS ((), (r), (b))"""))
def loss_stats(spark, d):
    return logs.loss_stats(A.history(spark, d), "rank", "bucket", "loss")


@query("G42_satisfaction", sql("mined", """SELECT rank::BIGINT AS rank, count(*) AS n_rows, round(avg((pred >= true_)::INT), 6) AS wrong, round(avg((pred < true_ AND pred + 0.1 > true_)::INT), 6) AS inside_margin, round(avg((pred + 0.1 <= true_)::INT), 6) AS satisfied
FROM mined
GROUP BY rank"""))
def satisfied(spark, d):
    return logs.satisfaction(_triplets(spark, d), ["rank"])


@query("G43_region_matrix", sql("mined", "SELECT least(i % 5, j % 5) AS low, greatest(i % 5, j % 5) AS high, count(*) AS n_rows, round(avg(err), 6) AS mean_err FROM mined GROUP BY ALL"))
def region_matrix(spark, d):
    m = A.mined(spark, d).withColumn("a", F.col("i") % 5).withColumn("b", F.col("j") % 5)
    return logs.region_matrix(m, "a", "b", "err")


@query("G47_combinations", sql("tax4", """, c AS (SELECT least(r1, r2) AS low, greatest(r1, r2) AS high, count(*) AS n
FROM tax4
GROUP BY ALL) SELECT low, high, n AS n_rows, round(n / (SELECT sum(n)
FROM c), 6) AS share
FROM c"""))
def combinations(spark, d):
    return logs.combination_shares(A.tax4(spark, d), "r1", "r2")


@query("G48_W14_changes", sql("history", """, t AS (SELECT batch, rank, round(quantile_cont(loss, 0.5), 6) AS cut
FROM history
GROUP BY ALL),
l AS (SELECT *, lag(cut) OVER (PARTITION BY rank ORDER BY batch) AS b
FROM t) SELECT batch, rank, cut, round((cut - b) / nullif(abs(b), 0), 6) AS change
FROM l"""))
def changes(spark, d):
    q = ordering.quantiles(A.history(spark, d).select("batch", "rank", "loss"), ["batch", "rank"], "loss", [0.5])
    t = q.select("batch", "rank", F.round(F.get("q", F.lit(0)), 6).alias("cut"))
    return logs.relative_changes(t, ["rank"], "batch", "cut")


@query("G51_history", sql("history", """SELECT batch, round(avg(loss) FILTER (rank = 'click'), 6) AS click, round(avg(loss) FILTER (rank = 'view'), 6) AS "view"
FROM history
GROUP BY batch"""))
def history_rows(spark, d):
    return logs.wide(A.history(spark, d), "batch", "rank", "loss", ["click", "view"])


@query("G52_filled_down", sql("history", """SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN round(loss, 6) END IGNORE NULLS) OVER (PARTITION BY rank ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS score
FROM history"""))
def filled(spark, d):
    h = A.history(spark, d).select("event_id", "rank", F.when(F.col("event_id") % 3 == 0, F.round("loss", 6)).alias("score"))
    return logs.filled_down(h, ["rank"], "event_id", "score").select("event_id", "score")


@query("G53_size_score", sql("tax4", """, t AS (SELECT r0, r1, count(*) AS n, sum((id % 13 = 0)::INT) AS s
FROM tax4
GROUP BY ALL) SELECT r0, count(*) AS n_taxa, round(corr(log2(n), s), 6) AS r
FROM t
GROUP BY r0
HAVING count(*) > 2 AND stddev_pop(n) > 0 AND stddev_pop(s) > 0"""))
def size_score(spark, d):
    t = A.tax4(spark, d).groupBy("r0", "r1").agg(F.count("*").alias("n"), F.count_if(F.col("id") % 13 == 0).alias("s"))
    return logs.size_score_correlation(t, "r0", "n", "s")


@query("U2_U3_U4_sets", """SELECT c_nationkey::BIGINT AS k, 'both' AS side
FROM customer INTERSECT SELECT s_nationkey, 'both'
FROM supplier
UNION ALL (SELECT DISTINCT c_nationkey, 'customer'
FROM customer
WHERE c_nationkey NOT IN (SELECT s_nationkey
FROM supplier))""")
def sets(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    s = A.table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.exceptAll(c.join(s, "k", "left_semi")).distinct().withColumn("side", F.lit("customer")))


@query("A16_U5_upsert", "SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 3 = 0 THEN '+' ELSE '' END AS s_name FROM supplier")
def upserted(spark, d):
    from .sources import fasta

    s = A.table(spark, d, "supplier").select("s_suppkey", "s_name")
    return fasta.upsert(s, s.where("s_suppkey % 3 = 0").withColumn("s_name", F.concat("s_name", F.lit("+"))), ["s_suppkey"])


@query("W1_W11_top", """SELECT c_mktsegment, c_custkey
FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n
FROM customer)
WHERE n <= 5""")
def top_rows(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return A.table(spark, d, "customer").withColumn("n", F.row_number().over(w)).where("n <= 5").select("c_mktsegment", "c_custkey")
