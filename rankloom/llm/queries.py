"""The thin queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, decontam, exact_dedup, html_text, near_dedup, packing, prefix_trie, quality, secret_scan, tokens, toxicity, url_filter
from .common import Scratch, text_or_empty

#: The rules of the URL query, as its contract states them.
RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)
#: Sites that the query's list holds, under each of the three domains.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns.unionByName(more)).withColumn("formatted", chat.formatted(F.col("segments")))
    back = chat.read_back(F.col("formatted"))
    out = out.select("conv_id", "valid", "formatted", back.alias("turns"), chat.loss_text(F.col("segments")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(17 + length(role) + length(text)
      + length(regexp_extract_all(text, '<\\*/s>|\[\\*/?INST\]'))
      + length(regexp_extract_all(role, '<\\*/s>|\[\\*/?INST\]')))::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text), '(system,)?user,assistant(,user,assistant)*') AS valid
FROM t GROUP BY conv_id
"""


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u): the sites above; the URLs of the pages that were reported, those with page_id % 8 = 5, as far as they name more than a site; and for each supplier the URL of a page that may not be linked."""
    sites = spark.createDataFrame([(f"{site}.{domain}/",) for site in LISTED_SITES for domain in LISTED_DOMAINS], "u string")
    host, path = url_filter.split_url("url")
    reported = table(spark, sf_dir, "pages").where("page_id % 8 = 5").select(host.alias("h"), path.alias("p")).where("h <> '' AND p NOT IN ('', '/')")
    pages = reported.select(url_filter.canonical(F.col("h"), F.col("p")).alias("u"))
    return sites.union(pages).union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("tionble.example.net/en/"), F.col("s_suppkey").cast("string"))))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES, url_list(spark, sf_dir))


OP3_SQL = r"""
WITH s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') AS whole FROM u),
l AS (SELECT a || '.' || b || '/' AS u FROM (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) x(a), (VALUES ('example.com'), ('example.net'), ('example.org')) y(b)
  UNION ALL SELECT whole FROM c WHERE page_id % 8 = 5 AND host <> '' AND path NOT IN ('', '/')
  UNION ALL SELECT 'tionble.example.net/en/' || s_suppkey FROM supplier),
r AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM c),
e AS (SELECT page_id FROM r JOIN (SELECT DISTINCT u FROM l) ON u = whole WHERE host <> ''
  UNION SELECT page_id FROM r JOIN (SELECT DISTINCT u FROM l WHERE u LIKE '%/') ON ends_with('.' || host || '/', '.' || u) WHERE host <> '')
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN page_id IN (FROM e) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + 12], ' ') AS t
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM b WHERE len(w) > 0)),
place AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT place.doc_id, place.s, place.n, win.item_id FROM place JOIN win ON place.t = win.t AND place.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


#: Words on either side of an item's rarest word within which its other words count as near.
REACH = 60


def items_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other search of operator 6's index: documents that hold all words of an item close together, in whatever order."""
    found = decontam.proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), REACH)
    return found.groupBy("doc_id", F.col("item").alias("item_id")).agg(F.count("*").alias("n_places"))


NEARBY_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dp AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM d),
bp AS (SELECT item_id, w, min(p) AS p FROM (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM b) GROUP BY item_id, w),
t AS (SELECT w, count(*) AS n FROM dp GROUP BY w),
r AS (SELECT item_id, count(*) AS n_all, arg_min(w, (coalesce(n, 0), p)) AS rare FROM bp LEFT JOIN t USING (w) GROUP BY item_id HAVING min(coalesce(n, 0)) > 0),
c AS (SELECT doc_id, pos, item_id, n_all FROM dp JOIN r ON w = rare)
SELECT doc_id, item_id, count(*) AS n_places FROM (
  SELECT c.doc_id, c.item_id, c.pos FROM c JOIN dp ON dp.doc_id = c.doc_id AND dp.pos BETWEEN c.pos - {REACH} AND c.pos + {REACH} JOIN bp ON bp.item_id = c.item_id AND bp.w = dp.w
  GROUP BY c.doc_id, c.item_id, c.pos, c.n_all HAVING count(DISTINCT dp.w) = c.n_all) GROUP BY doc_id, item_id
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = secret_scan.listed(F.filter("found", lambda s: s["kind"] < len(secret_scan.BASE)))
    return found.select(
        "doc_id", *[of(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(secret_scan.BASE)], F.sha2(base, 256).alias("base_sha256"), secret_scan.listed(F.col("found")).alias("spans")
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_sha256", F.sha2(text_or_empty("text"), 256))
    return exact_dedup.exact_duplicates(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 1], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
root AS (SELECT a AS doc_id, min(b) AS r FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(r, w.doc_id)) AS component_id,
  least(w.doc_id, coalesce(r, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)
"""

def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    turns = scratch.write(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    return prefix_trie.trie(prefix_trie.with_shared_start(turns, F.col("conv_id") - F.col("conv_id") % 100, shared, 5), scratch)


OP12_SQL = r"""
WITH t AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1))))) % 6)::INT AS h FROM t),
c AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1 : h.h], h.own[h.h + 1 :]) AS turns FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, len(turns) AS n, d, turns[1 : d] AS p, CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS chars FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM c)),
v AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, count(*) FILTER (WHERE n > d) AS longer,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM m GROUP BY p, d),
up AS (SELECT v.*, w.conv_id AS parent_conv_id, v.p[1 : v.d - 1] AS q FROM v LEFT JOIN v w ON v.d > 0 AND w.d = v.d - 1 AND w.p = v.p[1 : v.d - 1]),
kids AS (SELECT q AS p, count(*) AS n_children FROM up WHERE d > 0 GROUP BY q),
below AS (SELECT p[1 : k] AS p, count(*) FILTER (WHERE longer = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM v) GROUP BY 1)
SELECT up.conv_id, up.d::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM up LEFT JOIN kids ON kids.p = up.p JOIN below ON below.p = up.p
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.word_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), behind=(2,))
    return packing.pack(ids, packing.Limits(tokens=4096, segments=1024, loss=4096), with_ids=False)


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_chat, op3_url_filter, op4_toxicity, op5_html, op6_decontamination, op7_secrets, op8_exact_dedup, op9_bpe, op10_near_dedup, op11_alignment, op12_prefix_trie, op13_packing, items_nearby)
}
ORACLE_SQL = {"op2_chat": OP2_SQL, "op3_url_filter": OP3_SQL, "op6_decontamination": OP6_SQL, "items_nearby": NEARBY_SQL, "op8_exact_dedup": OP8_SQL, "op10_near_dedup": OP10_SQL, "op12_prefix_trie": OP12_SQL}
