"""Secrets in texts: three fixed patterns plus tokens that a character Markov model takes for random.

Two first-order character models, one of random strings and one of ordinary
identifiers, give each transition a log-likelihood ratio. They are trained from labelled
samples: RANDOM strings that are random by their making (digests in hexadecimal, base64
and letters with digits, as keys and tokens are written), and the identifiers of those
of SAMPLE documents, with the smallest id hash, in which no fixed pattern matches. The
models are one array of 65 * 65 ratios. All of it is DataFrame operations: match
positions follow from the lengths of what a pattern matches and of what it leaves
between.

Defined cases: a null text counts as empty and has no spans; rows with repeated or
null ids are scanned each by itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, among_least, text_or_empty

#: Kind, pattern, group that is measured, its least characters.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same hex runs as BASE finds, without stopping at every short one.
FAST = {"hex": r"[0-9a-f]{24,}"}
#: Words one of which a text must hold, in lower case, before a pattern is tried; they only save time.
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",)}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_-]{7,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_"
#: Documents and random strings that the models are trained on.
SAMPLE, RANDOM = 4000, 3000
#: Log-likelihood ratio from which a token counts as random: odds of about 22,000.
LEAST = 10.0
#: Matches whose places are summed in one run; longer lists go in runs, so that no list is copied whole for each match.
RUN = 256


def spans(text: Column, pattern: str, group: int = 0, least: int = 0, hints: tuple[str, ...] = ()) -> Column:
    """array<struct<start, end, body>> of a pattern's leftmost non-overlapping matches whose group has enough characters."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    place = lambda gap, length: F.struct(gap.alias("gap"), length.alias("len"))
    steps = F.filter(F.zip_with(F.transform(gaps, F.length), F.transform(hits, F.length), place), lambda s: s["len"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int>>")

    def run(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda a, s: F.struct(
                (a["at"] + s["gap"] + s["len"]).alias("at"),
                F.array_append(a["out"], F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["len"]).alias("end"))).alias("out"),
            ),
        )

    cut = F.transform(F.array(steps), lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / RUN).cast("int")), lambda k: run(F.slice(s, k * RUN + 1, F.lit(RUN)))))[0]
    moved = F.aggregate(
        cut,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")),
    )["starts"]
    placed = F.flatten(F.zip_with(cut, moved, lambda r, at: F.transform(r["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))))
    both = F.zip_with(placed, hits, lambda p, h: F.struct(p["start"].alias("start"), p["end"].alias("end"), (F.regexp_extract(h, pattern, group) if group else h).alias("body")))
    found = F.filter(both, lambda s: F.length(s["body"]) >= least)
    there = text.rlike(pattern)
    if hints:
        any_hint, low = F.lit(False), F.lower(text)
        for h in hints:
            any_hint = any_hint | low.contains(h)
        there = any_hint & there
    return F.when(there, found).otherwise(F.array().cast("array<struct<start:int,end:int,body:string>>"))


def base_spans(text: Column) -> list[Column]:
    return [spans(text, FAST.get(kind, pattern), group, least, HINTS.get(kind, ())).alias(kind) for kind, pattern, group, least in BASE]


def _place(c: Column) -> Column:
    """Index of a character in the alphabet, hyphen as the underscore, 64 for what it lacks."""
    at = F.instr(F.lit(ALPHABET), F.when(c == "-", "_").otherwise(c))
    return F.when(at > 0, at - 1).otherwise(64)


def _places(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), _place)


def random_strings(spark, n: int = RANDOM) -> DataFrame:
    """(s): strings as keys and tokens are written, of 32 to 44 characters, from digests of the numbers below n."""
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    letters = F.regexp_replace(coded, "[+/=]", "")
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, F.rtrim(F.translate(coded, "=", " "))).otherwise(letters).alias("s"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row, one column ``ratios``: array<double> of log P(random) - log P(identifier) for each pair of characters."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    some = scratch.write(among_least(rows, "id", sample).orderBy(F.xxhash64("id"), "id", "text").limit(sample), "sample")
    plain = some.where(F.size(F.concat(*base_spans(F.col("text")))) == 0).select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("s"))
    words = random_strings(spark).select("s", F.lit(1).alias("random")).union(plain.distinct().select("s", F.lit(0).alias("random"))).where("length(s) > 1")
    p = words.select("random", _places(F.col("s")).alias("p"))
    pairs = p.select("random", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda k: (F.get("p", k) * 65 + F.get("p", k + 1)).cast("long"))).alias("id"))
    counts = scratch.write(pairs.groupBy("id").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("i")), "counts")
    grid = spark.range(65 * 65).join(F.broadcast(counts), "id", "left").na.fill(0)  # 4,225 rows at most
    row = grid.groupBy(F.floor(F.col("id") / 65).alias("from")).agg(F.sum("r").alias("r_all"), F.sum("i").alias("i_all"))
    ratio = F.log((F.col("r") + 1) / (F.col("r_all") + 65)) - F.log((F.col("i") + 1) / (F.col("i_all") + 65))
    ratios = (
        grid.join(F.broadcast(row), F.floor(F.col("id") / 65) == F.col("from"))
        .agg(F.sort_array(F.collect_list(F.struct("id", ratio.alias("ratio")))).alias("all"))
        .select(F.transform("all", lambda x: x["ratio"]).alias("ratios"))
    )
    held = ratios.first()["ratios"]  # 4,225 numbers
    scratch.clear()
    return spark.createDataFrame([(held,)], "ratios array<double>")


def ratio_of(token: Column, ratios: Column) -> Column:
    """Log-likelihood ratio of a token, random against identifier."""
    return F.transform(
        F.array(_places(token)),
        lambda p: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p) - 1)), F.lit(0.0), lambda a, k: a + F.coalesce(F.get(ratios, F.get(p, k - 1) * 65 + F.get(p, k)), F.lit(0.0))),
    )[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """One row per row: id_col, found array<struct<start, kind (place in BASE, 3: random), end>> sorted, spans that the model adds overlap no base span."""
    held = (train(docs, id_col, text_col) if model is None else model).first()["ratios"]  # 4,225 numbers
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in held)), ",").cast("array<double>")
    text = F.col("__text")
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")).select("__id", *base_spans(text), spans(text, CANDIDATE).alias("more"))
    tag = lambda name, k: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    rows = rows.select("__id", "more", F.concat(*[tag(kind, k) for k, (kind, *_) in enumerate(BASE)]).alias("base"))
    free = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    added = F.when(F.size("more") > 0, F.filter(free, lambda c: ratio_of(c["body"], ratios) >= least)).otherwise(F.array().cast("array<struct<start:int,end:int,body:string>>"))
    return rows.select(F.col("__id").alias(id_col), F.sort_array(F.concat("base", F.transform(added, lambda s: F.struct(s["start"].alias("start"), F.lit(len(BASE)).alias("kind"), s["end"].alias("end"))))).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined in their order."""
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("random"))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
