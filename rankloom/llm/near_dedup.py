"""Near duplicates: an LSH forest over MinHash labels of adaptive depth; all links are confirmed on full shingle sets.

1. Every text becomes its set of hashed word shingles; ``TREES * DEPTH`` MinHash
   values are cut to one byte each, and a tree's label string is DEPTH of them.
2. Documents with equal sets collapse into one class by a partially aggregated
   ``groupBy``, so thousands of copies cost one row further on.
3. All trees' label strings are range-partitioned and sorted together. In a sorted
   order the nearest rows have the longest common prefix: each row is paired with its
   next ``WINDOW`` rows that share at least ``NEED`` labels with it. How many more they
   share adapts to how crowded the region is. The first and last rows of each partition
   are returned as well and paired across its border.
4. Pairs are confirmed on their whole sets: first each class's pair that most trees
   name, then those pairs whose ends are not yet in one component.
5. Where more rows share NEED labels than the window reaches, a region is crowded. Rows
   of a crowded region that the links have not made one component are searched exactly.
   All sets are put into one order, shingles that are common in a sample of the texts
   last; two sets similar enough share a shingle within their first
   ``n - ceil(t * n) + 1``, at places that leave room for the overlap needed. Postings of
   these prefixes meet by shingle, once for each component, and pairs whose counts of
   shingles in 256 buckets rule out the overlap are dropped. Whatever the sample holds,
   no pair is lost: it only decides how many are compared.

What may be lost is a link whose ends share fewer than NEED labels in every tree: with
24 trees and four labels, three in a million links at similarity 0.8 exactly, fewer
above (``(1 - 0.8 ** 4) ** 24``). Nothing else is cut: no cap on partners, buckets or
candidates, and filters between the steps only drop pairs that can't reach the
threshold.

Defined cases: null and empty texts, and texts without words, have no shingles and
are linked with nothing; a text of fewer words than the shingle length is one
shingle; a row that repeats an id gets the component of its own text's class, and two
classes whose smallest ids are the same are one; rows with a null id (or one that is no
whole number) get a null component and take no part in links; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, Scratch, filter_words, if_few, kept, maybe_in, those_in

#: Trees, labels of a tree, rows that a row is paired with, labels that a pair shares at least.
TREES, DEPTH, WINDOW, NEED = 24, 8, 2, 4
#: Rows of the borders between partitions that one task takes.
BORDER = 200_000
#: Tasks for a counted table of at most FEW rows.
TASKS = 8
#: Sets that one Arrow batch holds.
ROWS = 500
#: Shingles that are hashed at once; bounds a task's memory on very long texts.
CHUNK = 2048
#: Texts that are sampled for common shingles, and how many of these are known at most; they decide the order of sets, never the result.
SAMPLE, COMMON = 4_000, 1 << 16
#: Rows of one shingle that meet in one task.
SALT = 2000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; words are runs without ASCII white space, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(kept("shingles", _Words).__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
        out *= _ODD
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    return draw.integers(0, 1 << 32, n, np.uint32)[:, None], (draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1))[:, None]


def labels(shingles: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> bytes:
    """One byte for each seed: the MinHash under that seed, hashed down."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), CHUNK):
        low = np.minimum(low, ((x[None, at : at + CHUNK] ^ xor) * mul).min(axis=1))
    return ((low * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _signer(width: int, n_labels: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, mul = _seeds(n_labels)
        for batch in batches:
            sets, sizes, signs, counted = [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), width)
                sizes.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signs.append(labels(s, xor, mul) if len(s) else None)
                counted.append(_counted(s))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (sets, signs, counted))], names=["id", "n", "same", "labels", "counted"])

    return sign


def _counted(s: np.ndarray) -> bytes | None:
    """How many shingles fall into each of 256 buckets; None where a byte can't hold a count."""
    in_bucket = np.bincount(s.view(np.int64) & 255, minlength=256)
    return in_bucket.astype(np.uint8).tobytes() if len(s) and in_bucket.max() < 256 else None


def _shingler(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            sets = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "n", "shingles"])

    return cut


def _prefixer(width: int, percent: int, common: tuple[np.ndarray, np.ndarray]):
    """The shingles of each set's prefix, common ones last; common: sorted shingles and how often a sample has them."""
    known, counts = common

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 4 * ROWS) for b in batches for at in range(0, b.num_rows, 4 * ROWS)):
            sizes, prefixes = [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), width).view(np.int64)
                n = len(s)
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.lexsort((s, np.where(known[at] == s, counts[at], 0)))]
                sizes.append(n)
                prefixes.append(s[: n - (percent * n + 99) // 100 + 1])
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], names=["id", "n", "prefix"])

    return cut


def _overlapping(percent: int):
    """Pairs whose overlap may be large enough: at most the sum of the lesser counts over 256 buckets of shingles. Rows: (a, b, sizes, x, y)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, 256) for k in (3, 4))
                most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                ok = pa.array((100 + percent) * most >= percent * part.column(2).to_numpy())
                yield pa.record_batch([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    return keep


def _neighbours(percent: int, window: int, edges: bool):
    """Pairs each row of a sorted run with the next rows; edges: also returns the first and last rows of the run.

    Rows that come out: (a, b) a pair; (order, id) a row whose region reaches beyond the window, order being what
    the region shares; (order, id, n, place) a row at an edge.
    """
    names, reach, shared = ["a", "b", "place", "order", "id", "n"], window + 1, 1 + NEED
    none = lambda k, kind=pa.int64(): pa.nulls(k, kind)

    def edge_rows(t: pa.Table, at: int) -> pa.RecordBatch:
        k = t.num_rows
        return pa.record_batch([none(k), none(k), pa.array(range(at, at + k), pa.int64()), *(t.column(c).combine_chunks() for c in ("order", "id", "n"))], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            if edges and place < reach:
                yield edge_rows(new.slice(0, reach - place), place)
            t = pa.concat_tables([held, new]).combine_chunks() if held is not None else new
            old, rows = held.num_rows if held is not None else 0, t.num_rows
            head = np.frombuffer(b"".join(t.column("order").to_pylist()), np.uint8).reshape(rows, -1)[:, :shared]
            ids, size = t.column("id").to_numpy(), t.column("n").to_numpy()
            for j in range(1, min(reach, rows - 1) + 1):
                at = np.flatnonzero((head[j:] == head[:-j]).all(axis=1))
                at = at[at + j >= old]
                if j <= window:
                    small, large = np.minimum(size[at], size[at + j]), np.maximum(size[at], size[at + j])
                    at = at[100 * small >= percent * large]
                    if len(at):
                        a, b = np.minimum(ids[at], ids[at + j]), np.maximum(ids[at], ids[at + j])
                        yield pa.record_batch([pa.array(a), pa.array(b), none(len(at)), none(len(at), pa.binary()), none(len(at)), none(len(at))], names=names)
                elif len(at):
                    both = np.union1d(at, at + j)
                    region = pa.array([h.tobytes() for h in head[both]], pa.binary())
                    yield pa.record_batch([none(len(both)), none(len(both)), none(len(both)), region, pa.array(ids[both]), none(len(both))], names=names)
            place += batch.num_rows
            held = t.slice(max(0, rows - reach))
        if edges and held is not None and place > reach:
            last = min(held.num_rows, place - reach)
            yield edge_rows(held.slice(held.num_rows - last), place - last)

    return walk


def forest(reps: DataFrame, percent: int, scratch: Scratch, trees: int = TREES, depth: int = DEPTH, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b, trees: how many name it) of longest-common-prefix neighbours, and (region, id) of rows in regions that the window doesn't cover. reps: (id, n, labels)."""
    rows = reps.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "id", "n", "labels").select(
        F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(labels, tree * {depth} + 1, {depth})")).alias("order"), "id", "n"
    )
    schema = "a long, b long, place long, `order` binary, id long, n long"
    ordered = rows.repartitionByRange("order", "id").sortWithinPartitions("order", "id")
    found, out = scratch.write(ordered.mapInArrow(_neighbours(percent, window, True), schema), "neighbours"), []
    while True:
        out.append(found.where("place is null"))
        # 2 * (window + 1) rows of each partition, whatever it holds: what a border separates is found among them.
        border = found.where("place is not null").select("order", "id", "n")
        parts = -(-border.count() // BORDER)
        if parts <= 1:
            out.append(border.repartition(1).sortWithinPartitions("order", "id").mapInArrow(_neighbours(percent, window, False), schema))
            break
        border = border.repartitionByRange(parts, "order", "id").sortWithinPartitions("order", "id")
        found = scratch.write(border.mapInArrow(_neighbours(percent, window, True), schema), "neighbours")
    all_rows = out[0]
    for more in out[1:]:
        all_rows = all_rows.unionByName(more)
    pairs = all_rows.where("a < b").groupBy("a", "b").agg(F.count("*").alias("trees"))
    crowded = all_rows.where("a is null").select(F.col("order").alias("region"), "id").distinct()
    return scratch.write(pairs, "pairs"), scratch.write(crowded, "crowded")


def confirmed_links(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch, counts: DataFrame | None = None) -> DataFrame:
    """The pairs whose full sets have 100 * |intersection| >= percent * |union|. docs: (id, text); pairs: (a, b), written.

    counts: (id, n, counted), written; with it an upper bound of the overlap is looked at before any text is read, which pays where many pairs are hopeless.
    """
    likely = pairs.select("a", "b")
    if counts is not None:  # sets too large to be counted in bytes go on unchecked
        of = lambda a, n, x: counts.select(F.col("id").alias(a), F.col("n").alias(n), F.col("counted").alias(x))
        both = scratch.write(likely.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b"), "counted")
        within = both.where("x is not null and y is not null").select("a", "b", F.expr("n + m").alias("sizes"), "x", "y").mapInArrow(_overlapping(percent), "a long, b long")
        likely = scratch.write(within.union(both.where("x is null or y is null").select("a", "b")).distinct(), "likely")
    ends = scratch.write(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    sets = scratch.write(those_in(docs, "id", ends).mapInArrow(_shingler(width), "id long, n long, shingles array<bigint>"), "shingles")
    of = lambda a, n, x: sets.select(F.col("id").alias(a), F.col("n").alias(n), F.col("shingles").alias(x))
    met = likely.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    links = scratch.write(met.where(100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b").distinct(), "links")
    scratch.drop("ends", "shingles", "counted", "likely")
    return links


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, with their counts; at most COMMON of about SAMPLE texts."""
    n = docs.count()
    some = docs.where(F.xxhash64("id") <= F.lit(SAMPLE * (1 << 64) // n - (1 << 63))) if n > SAMPLE else docs
    held = some.mapInArrow(_shingler(width), "id long, n long, shingles array<bigint>").select(F.explode("shingles").alias("s"))
    rows = held.groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).collect()
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _least_shared(percent: int) -> str:
    """100 * (100 + percent) times what the shingles shared by two prefixes exceed, if one set has n_a shingles and the other low to high, as SQL.

    A prefix lacks ceil(t * n) - 1 shingles of its set, and the prefix that ends first holds all but n - overlap of its own in common; so the
    prefixes share overlap - ceil(t * max) + 1 at least. Over the sizes that can be similar enough, this is least at either end.
    """
    low, high = f"greatest(low, {percent} * n_a div 100)", f"least(high, 100 * n_a div {max(1, percent)} + 1)"
    at = lambda n: f"{100 * percent} * (n_a + {n}) - {percent * (100 + percent)} * greatest(n_a, {n})"
    return f"least({at(low)}, {at(high)})"


def prefix_pairs(docs: DataFrame, roots: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs (a < b) of different components that may reach the threshold, none missing. docs: (id, text), roots: (id, root)."""
    cut = _prefixer(width, percent, common_shingles(docs, width))
    sets = scratch.write(docs.mapInArrow(cut, "id long, n long, prefix array<bigint>"), "prefixes")
    # rest: how many shingles of the set can still be shared when this is the first one that is.
    rows = sets.select("id", "n", F.posexplode("prefix").alias("place", "s")).select("s", "id", "n", (F.col("n") - F.col("place")).alias("rest"))
    shared = scratch.write(rows.groupBy("s").count().where("count > 1").select("s", F.ceil(F.col("count") / SALT).cast("int").alias("parts")), "shared")
    rows = maybe_in(rows, F.col("s"), filter_words(shared, F.col("s"))).join(shared, "s").join(roots, "id", "left")
    rows = scratch.write(rows.select("s", F.coalesce("root", "id").alias("c"), "id", "n", "rest", "parts"), "postings")
    groups = rows.groupBy("s", "c").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"), F.max("parts").alias("parts"))
    groups = scratch.write(groups, "groups")

    def side(df: DataFrame, end: str, salt) -> DataFrame:
        return df.withColumn("salt", salt).select("s", "salt", *[F.col(k).alias(f"{k}_{end}") for k in df.columns if k not in ("s", "parts")])

    x = side(groups, "a", F.pmod(F.xxhash64("c"), "parts").cast("int"))
    y = side(groups, "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    room = f"{100 + percent} * least(rest_a, rest_b) >= {percent} * "
    met = x.join(y, ["s", "salt"]).where(f"c_a < c_b AND 100 * high_a >= {percent} * low_b AND 100 * high_b >= {percent} * low_a AND {room} (low_a + low_b)")
    met = scratch.write(met.select("s", "c_a", "c_b", "id_a", "id_b", (F.col("id_a").eqNullSafe(F.col("last_a")) & F.col("id_b").eqNullSafe(F.col("last_b"))).alias("single")), "met")
    # Of two components that are not one row each, the one with fewer shingles goes out row by row.
    wide = groups.groupBy("c").agg(F.count("*").alias("k"), F.min("low").alias("low"), F.max("high").alias("high"))
    of = lambda end: wide.select(*[F.col(k).alias(f"{k}_{end}") for k in wide.columns])
    several = met.where("not single").select("s", "c_a", "c_b").join(of("a"), "c_a").join(of("b"), "c_b")
    ends = [F.when(F.col("k_b") <= F.col("k_a"), F.col(f"{k}_{x}")).otherwise(F.col(f"{k}_{y}")) for k, x, y in (("c", "a", "b"), ("c", "b", "a"), ("low", "a", "b"), ("high", "a", "b"))]
    several = scratch.write(several.select("s", *[c.alias(k) for c, k in zip(ends, ("many", "few", "low", "high"), strict=True)]), "several")
    own = rows.select("s", F.col("c").alias("few"), F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
    theirs = rows.select("s", F.col("c").alias("many"), F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"))
    # Two sets that reach the threshold share more than one shingle of their prefixes, the more the nearer their sizes are; a row that shares
    # fewer with a whole component has no link to it.
    tried = several.select("many", "few", "low", "high").distinct().join(own, "few").join(groups.select("s", F.col("c").alias("many")), ["s", "many"])
    shared = tried.groupBy("many", "id_a", "n_a", "low", "high").agg(F.count("*").alias("shared"))
    near = shared.where(f"100 * {100 + percent} * shared > {_least_shared(percent)}").select("many", "id_a", "n_a")
    near = scratch.write(near, "near")
    met_rows = several.select("s", "many", "few").join(own, ["s", "few"]).join(near, ["many", "id_a", "n_a"], "left_semi").join(theirs, ["s", "many"])
    met_rows = met_rows.where(f"100 * n_a >= {percent} * n_b AND 100 * n_b >= {percent} * n_a AND {room} (n_a + n_b)")
    pairs = met.where("single").select("id_a", "id_b").union(met_rows.select("id_a", "id_b"))
    pairs = pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).where("a < b").distinct()
    pairs = scratch.write(pairs, "pairs")
    scratch.drop("prefixes", "shared", "postings", "groups", "met", "several", "near")
    return pairs


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): the smallest id reachable over the links, for every id that has a link.

    Large-star and small-star rounds until every component is a star: each node has one edge, to a node
    that has none downwards. A node's edges are never gathered. Its minimum is aggregated in parts and joined
    back to them: the minima of few edges are broadcast; those of many are written first, so that both sides of
    that join are scans and adaptive execution may split a centre's rows.
    """
    edges, k = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges0"), 0
    while True:
        n = edges.count()
        few = 2 * n <= FEW
        # Few edges are no work for as many tasks as a shuffle has partitions.
        slim = (lambda df: df.coalesce(TASKS)) if few else (lambda df: df)
        if edges.select("v").join(if_few(edges.select("u"), n), F.col("v") == F.col("u"), "left_semi").isEmpty() and edges.agg(F.count_distinct("u")).first()[0] == n:
            break
        held = (lambda df, name: F.broadcast(slim(df))) if few else (lambda df, name: scratch.write(df, name))
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = held(both.groupBy("u").agg(F.min("v").alias("m")), "low")
        large = scratch.write(slim(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()), "large")
        floor = held(large.groupBy("u").agg(F.min("v").alias("m")), "floor")
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        small = large.join(floor, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        k += 1
        edges = scratch.write(slim(small), f"edges{k}")
        scratch.drop("low", "large", "floor", f"edges{k - 1}")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
    roots = scratch.write(slim(roots), "roots")
    scratch.drop(f"edges{k}")
    return roots


def linked(reps: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """(id, root) of all classes that have a link. reps: (id, n, labels, counted), written; texts: (id, text)."""
    pairs, crowded = forest(reps.select("id", "n", "labels"), percent, scratch)
    counts = reps.select("id", "n", "counted")
    scratch.drop("neighbours")
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "trees").union(pairs.select("b", "a", "trees"))
    best = ends.groupBy("id").agg(F.max_by("other", F.struct("trees", "other")).alias("other"))
    first = scratch.write(best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "first")
    links = confirmed_links(first, texts, width, percent, scratch)
    roots = components(links, scratch)
    scratch.drop("links")

    def root_of(rows: DataFrame, key: str, name: str, n: int) -> DataFrame:
        met = rows.join(if_few(roots.select(F.col("id").alias("__id"), F.col("root").alias("__root")), n), F.col(key) == F.col("__id"), "left")
        return met.select(*rows.columns, F.coalesce("__root", key).alias(name))

    def merged(links: DataFrame) -> DataFrame:
        held = scratch.write(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(links), "held")
        scratch.drop("links", "roots")
        got = components(held, scratch)
        scratch.drop("held")
        return got

    others, n = pairs.select("a", "b").join(if_few(first), ["a", "b"], "left_anti"), roots.count()
    apart = scratch.write(root_of(root_of(others, "a", "ra", n), "b", "rb", n).where("ra <> rb").select("a", "b"), "apart")
    scratch.drop("first", "pairs")
    links = confirmed_links(apart, texts, width, percent, scratch, counts)
    roots = merged(links)
    scratch.drop("apart")
    # Crowded regions that are not one component, and the ids of their rows.
    placed = scratch.write(root_of(crowded, "id", "root", roots.count()), "placed")
    scratch.drop("crowded")
    open_regions = placed.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    left = scratch.write(maybe_in(placed, F.col("region"), filter_words(open_regions, F.col("region"))).select("id").distinct(), "left")
    scratch.drop("placed")
    if not left.isEmpty():
        links = confirmed_links(prefix_pairs(those_in(texts, "id", left), roots, width, percent, scratch), texts, width, percent, scratch, counts)
        if not links.isEmpty():
            roots = merged(links)
        scratch.drop("pairs", "links")
    scratch.drop("left")
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (smallest id reachable over links), kept. The result reads tables of ``scratch``."""
    scratch = scratch or Scratch(docs.sparkSession)
    slim = docs.select(F.col(id_col).try_cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.write(slim.mapInArrow(_signer(width, TREES * DEPTH), "id long, n long, same binary, labels binary, counted binary"), "signatures")
    full = signed.where("same is not null and id is not null")
    reps = scratch.write(full.groupBy("same").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("labels").alias("labels"), F.first("counted").alias("counted")), "classes")
    roots = linked(reps.select("id", "n", "labels", "counted"), slim.where("id is not null"), width, percent, scratch)
    named = scratch.write(reps.select("same", "id").join(if_few(roots), "id", "left").select("same", F.coalesce("root", "id").alias("component")), "named")
    # Rows without shingles stand alone.
    alone = signed.where("same is null or id is null").select("id", "n", F.col("id").alias("component"))
    rows = full.select("id", "n", "same").join(named, "same").select("id", "n", "component").unionByName(alone)
    scratch.drop("classes", "roots")
    scratch.settle()
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
    )
