"""Benchmark decontamination on a positional inverted index, in DataFrame operations only.

1. The index. One pass over the training texts writes the postings (row, term, position)
   of every term that the benchmark has, and for each row how many words it has. It lies
   in the shared folder in the order of the rows, so the lists of one row stay together;
   all that follows reads the index, never the texts.
2. Corpus frequencies of the terms are counted from the postings.
3. In each benchmark window the rarest term and the second rarest are its entries; windows
   beside each other mostly share them, so an item has few. A window with a term that the
   corpus lacks can't occur and has none.
4. The postings of the rarest terms, moved back by their place in the item, are possible
   alignments (row, item, shift). They are intersected with the postings of the second
   rarest terms, moved back alike.
5. What is left is intersected with the postings of all other terms around the entry, by
   (row, position, term): 13 places on end that agree are an exact occurrence.

Lists are intersected by equi-joins on (row, item, shift) or (row, position), so a frequent
term's postings spread over all tasks; items and entries are the query side, broadcast
where their counted rows allow.

Proximity search uses the same index: around each posting of an item's rarest term, the
other terms must have a posting within reach.

Defined cases: null and empty texts have no words; an item of fewer words than a window is
one window, an item of none has no window; equal windows of several items count for each of
them, rows of a repeated item id are one item's texts; each row of a repeated document id is
judged by its own text (null ids too); an empty table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, filter_words, maybe_in, text_or_empty

#: What stands between words, A-Z being letters of words: the complement of the word pattern.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE = 13
#: Rows of one block of terms or entries, which is what may be broadcast at once (a few numbers or one word each: under 10 MB).
BLOCK = 100_000
#: Stands behind a row's last word, so that the index says how many words there are; no word has a space.
END = " "


def words(text: str | Column) -> Column:
    """The words of a text in order, in their own case: A-Z is put in lower case where words are compared.

    An empty string stands first or last where the text begins or ends between words.
    """
    return F.split(text_or_empty(text), BETWEEN, -1)


def plain(word: Column) -> Column:
    """A word with A-Z in lower case; most words are ASCII, where lower() does just that and is faster."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word))


def blocks(df: DataFrame, key: str, size: int = BLOCK) -> list[DataFrame]:
    """df in blocks that each are small enough to broadcast; how many follows from its counted rows."""
    n = -(-df.count() // size)
    if n <= 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(4 * n)) % n == k) for k in range(n)]


def beside(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """df joined with a query side: broadcast if its counted rows allow, else shuffled."""
    return df.join(F.broadcast(small) if small.count() <= BLOCK else small, on, how)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, part, n_terms, at, term): the words of the items by place; part tells the rows of one item id apart."""
    t = F.array_remove(F.split(ascii_lower(text_or_empty(text_col)), BETWEEN, -1), "")
    cut = items.select(F.col(id_col).alias("item"), t.alias("t")).where(F.size("t") > 0).distinct()
    return cut.select("item", F.xxhash64("t").alias("part"), F.size("t").alias("n_terms"), F.posexplode("t").alias("at", "term"))


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(row, id, term_id, pos), written: the postings of the terms, and one row with term_id -1 for each row of docs whose pos is its number of words."""
    rows, parts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), blocks(terms, "term")
    if len(parts) > 1:  # every block reads the rows anew, and they must have the same numbers then
        rows = scratch.write(rows, "numbered")
    rows = rows.select("row", "id", words("text").alias("tokens"))
    # Words are empty at most at either end; they keep their place and are taken off the count.
    empty = lambda k: F.coalesce(F.get("tokens", k) == "", F.lit(False)).cast("int")
    n = F.size("tokens")
    n_words = n - empty(F.lit(0)) - F.when(n > 1, empty(n - 1)).otherwise(0)
    out = []
    for k, block in enumerate(parts):
        tokens = F.array_append("tokens", END) if k == 0 else F.col("tokens")
        if k == 0:
            block = block.union(terms.sparkSession.range(1).select(F.lit(END), F.lit(-1).cast("long")))
        # The count rides on every word until the join has left few of them; of the END row it is the position.
        each = rows.select("row", "id", n_words.alias("n_words"), F.posexplode(tokens).alias("pos", "t")).select("row", "id", "n_words", "pos", plain(F.col("t")).alias("term"))
        hits = each.join(F.broadcast(block), "term")
        out.append(hits.select("row", "id", "term_id", F.when(F.col("term_id") < 0, F.col("n_words")).otherwise(F.col("pos")).alias("pos")))
    index = scratch.write(union(out), "index")
    scratch.drop("numbered")
    return index


def search_terms(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The index, and (item, part, n_terms, at, term_id, n) of the items' words, n being the corpus frequency (0 where it has none)."""
    told = scratch.write(item_terms(items, item_id, item_text), "items")
    terms = scratch.write(told.select("term").distinct().select("term", F.monotonically_increasing_id().alias("term_id")), "terms")
    index = positional_index(docs, terms, id_col, text_col, scratch)
    counts = index.where("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("n"))
    known = scratch.write(terms.join(counts, "term_id", "left").select("term", "term_id", F.coalesce("n", F.lit(0)).alias("n")), "known")
    placed = scratch.write(beside(told, known, ["term"]).select("item", "part", "n_terms", "at", "term_id", "n"), "placed")
    scratch.drop("items", "terms", "known")
    return index, placed


def entries(placed: DataFrame, size: int) -> DataFrame:
    """(item, part, n_terms, rare, at, second, at2): the two rarest terms of each window all of whose terms the corpus has, and their places; at2 is null in windows of one word."""
    first = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - (size - 1)), F.greatest(F.lit(0), F.least("at", F.col("n_terms") - size)))).alias("start")
    each = placed.select("item", "part", "n_terms", first, F.struct("n", "at", "term_id").alias("x"))
    held = each.groupBy("item", "part", "n_terms", "start").agg(F.sort_array(F.collect_list("x")).alias("x")).where(F.col("x")[0]["n"] > 0)
    a, b = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    return held.select("item", "part", "n_terms", a["term_id"].alias("rare"), a["at"].alias("at"), b["term_id"].alias("second"), b["at"].alias("at2")).distinct()


def alignments(index: DataFrame, entry: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, item, part, n_terms, shift, at), written: where the two rarest terms of a window stand as far apart as in the item."""

    def lists(term: str, at: str, more: list[str]) -> DataFrame:
        each = entry.where(f"{term} is not null").select("item", "part", "n_terms", F.col(term).alias("term_id"), at, *more).distinct()
        return beside(index, each, ["term_id"]).select("row", "item", "part", "n_terms", (F.col("pos") - F.col(at)).alias("shift"), at, *more)

    keys = ["row", "item", "part", "n_terms", "shift"]
    rare = lists("rare", "at", ["at2"])
    both = rare.where("at2 is not null").join(lists("second", "at2", []), [*keys, "at2"], "left_semi")
    return scratch.write(both.unionByName(rare.where("at2 is null")).select(*keys, "at").distinct(), "alignments")


def occurrences(index: DataFrame, placed: DataFrame, aligned: DataFrame, size: int) -> DataFrame:
    """(row, item, start, end): every place where a window of an item stands word for word; end is exclusive."""
    span = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - (size - 1)), F.least(F.col("n_terms") - 1, F.col("at") + (size - 1)))).alias("at")
    wanted = aligned.select("row", "item", "part", "n_terms", "shift", span).distinct()
    wanted = beside(wanted, placed.select("item", "part", "at", "term_id"), ["item", "part", "at"]).withColumn("pos", F.col("shift") + F.col("at"))
    near = maybe_in(index, F.col("row"), filter_words(aligned.select("row").distinct(), F.col("row"))).select("row", "pos", "term_id")
    agreed = wanted.join(near, ["row", "pos", "term_id"]).groupBy("row", "item", "part", "n_terms", "shift").agg(F.sort_array(F.collect_list("at")).alias("found"))
    need = F.least(F.col("n_terms"), F.lit(size))
    runs = F.filter(F.transform("found", lambda a, k: F.when(F.get("found", k + need - 1) == a + need - 1, a)), lambda a: a.isNotNull())
    start = F.col("shift") + F.col("a")
    return agreed.select("row", "item", "shift", need.alias("need"), F.explode(runs).alias("a")).select("row", "item", start.alias("start"), (start + F.col("need")).alias("end")).distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, id, n_words) of all rows, and (row, item, start, end) of all exact occurrences of windows; both written."""
    scratch = scratch or Scratch(docs.sparkSession)
    index, placed = search_terms(docs, items, id_col, text_col, item_id, item_text, scratch)
    entry = scratch.write(entries(placed, size), "entries")
    aligned = alignments(index.where("term_id >= 0"), entry, scratch)
    hits = scratch.write(occurrences(index.where("term_id >= 0"), placed, aligned, size), "occurrences")
    rows = scratch.write(index.where("term_id < 0").select("row", "id", F.col("pos").cast("long").alias("n_words")), "rows")
    scratch.drop("index", "placed", "entries", "alignments")
    return rows, hits


def proximity_matches(docs: DataFrame, items: DataFrame, reach: int, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id_col, item, pos): postings of an item's rarest term (the first of equals in the item) with all its other terms within ``reach`` words on either side."""
    scratch = scratch or Scratch(docs.sparkSession)
    index, placed = search_terms(docs, items, id_col, text_col, item_id, item_text, scratch)
    terms = placed.groupBy("item", "part", "term_id", "n").agg(F.min("at").alias("at"))
    whole = terms.groupBy("item", "part").agg(F.count("*").alias("n_all"), F.min(F.struct("n", "at", "term_id")).alias("x")).where("x.n > 0")
    entry = whole.select("item", "part", "n_all", F.col("x.term_id").alias("term_id"))
    near = beside(index.where("term_id >= 0"), entry, ["term_id"]).select("row", "id", "item", "part", "n_all", F.col("pos").alias("centre"))
    near = scratch.write(near, "centres")
    around = near.select("row", "id", "item", "part", "n_all", "centre", F.explode(F.sequence(F.greatest(F.lit(0), F.col("centre") - reach), F.col("centre") + reach)).alias("pos"))
    lists = maybe_in(index.where("term_id >= 0"), F.col("row"), filter_words(near.select("row").distinct(), F.col("row"))).select("row", "pos", "term_id")
    met = around.join(lists, ["row", "pos"])
    own = terms.select("item", "part", "term_id")
    met = beside(met, own, ["item", "part", "term_id"], "left_semi")
    found = met.groupBy("row", "id", "item", "part", "n_all", "centre").agg(F.count_distinct("term_id").alias("seen")).where("seen = n_all")
    return found.select(F.col("id").alias(id_col), "item", F.col("centre").alias("pos")).distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, share: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """One row per row: id_col, n_words, n_hit, n_items, items (sorted as strings), contaminated (n_hit > 0 and share * n_hit >= n_words). The result reads tables of ``scratch``."""
    rows, hits = phrase_matches(docs, items, id_col, text_col, item_id, item_text, size, scratch)
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.select("row", "start", "end").distinct().withColumn("held", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "held"))).cast("long").alias("n_hit"))
    )
    named = hits.select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    judged = covered.join(named, "row")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(judged, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
