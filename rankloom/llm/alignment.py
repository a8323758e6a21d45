"""Cross-tokenizer alignment: which tokens of two vocabularies stand over the same bytes of a text.

The ends of both vocabularies' tokens cut a text's bytes into elementary intervals; each lies in
one token of either, so each is one link, and an end that both have closes a group. Both
tokenizers cut where white space begins, so texts go by units that are coded, aligned
and remembered once (see ``tokens``); the units that a batch of texts brings anew are
aligned in one pass over their joined bytes: the union of both end arrays, and for each of its
intervals the owners by binary search.

How often two ids are linked in the whole corpus is counted from each text's pairs, which are
written once. The commonest pairs, at most HOT of them, are broadcast; the others, each
rarer than all of these, meet their counts in a shuffle, so no key is hot there.

Defined cases: null and empty texts, and texts that the tokens of either vocabulary don't give back byte
for byte, have no tokens: zeros and an empty column groups; special tokens' strings in a text are plain text; ids
may repeat or be null, each row is a text of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from .bpe import SPLIT, byte_letters
from .common import FEW, Scratch
from .tokens import ROWS, Numbered, Parts, coder, gathered

#: Pairs of ids whose counts are broadcast at most (17 bytes each), and pairs that a task counts at once.
HOT, COUNTED = FEW, 1 << 21
#: Fixed value: what the byte-level split takes for white space, as the inside of a character class.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: All of these characters.
WHITE_CHARS = "".join(re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))
SPACE = "▁"
#: Characters that every Unicode version splits alike.
PLAIN = re.compile("[\t-\r -~¡-įı-ɏ]+")
#: A token's id of the first vocabulary times this, plus one of the second, is a pair's key.
SECOND = 1 << 32


class Aligner:
    """Both tokenizers, and the units that they and the alignment have been applied to."""

    def __init__(self, bytelevel: str, pieces: bytes):
        self.library = Tokenizer.from_str(bytelevel)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.parts, self.split = Parts(self.library.model), regex.compile(SPLIT)
        letters = byte_letters()
        self.label_a = self._labels(self.library.get_vocab(with_added_tokens=False), lambda s: bytes(letters[c] for c in s))
        self.second = SentencePieceProcessor(model_proto=pieces)
        ids = range(self.second.get_piece_size())
        names = {self.second.id_to_piece(k): k for k in ids}
        self.label_b = self._labels(names, lambda s: bytes([int(s[3:5], 16)]) if self.second.is_byte(names[s]) else s.replace(SPACE, " ").encode())
        self.space = self.second.piece_to_id(SPACE)
        self.units = self._units(names)
        self.known = Numbered()
        self.text, self.good = [], np.empty(0, bool)
        self.numbers = np.empty((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.pairs, self.start = np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def _labels(vocab: dict[str, int], told) -> list[bytes]:
        out = [b""] * (max(vocab.values()) + 1)
        for name, k in vocab.items():
            out[k] = told(name)
        return out

    def _units(self, names: dict[str, int]):
        """The pattern of units: from a run of white space on, up to the next one.

        A run that begins with a character that pieces have behind others doesn't cut; none does so with the
        space itself and with the line feed, by which units are coded apart, or this isn't the vocabulary for it.
        """
        inside = {c for s in names for c in re.findall(f"[{WHITE}{SPACE}]", s.lstrip(WHITE_CHARS + SPACE))}
        if {SPACE, "\n"} & inside or any("\n" in s for s in names):
            raise ValueError("pieces of the second vocabulary go across white space")
        glued = "".join(sorted(inside))
        return re.compile(f"[{WHITE}]*[^{WHITE}]+(?:[{glued}][{WHITE}]*[^{WHITE}]*)*|[{WHITE}]+" if glued else f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

    def _first(self, unit: str) -> tuple[int, ...] | list[int]:
        if unit[unit[0] == " " :].isalpha() and unit.isascii():
            return self.parts[unit]
        if PLAIN.fullmatch(unit):
            return [k for p in self.split.findall(unit) for k in self.parts[p]]
        return self.library.encode(unit, add_special_tokens=False).ids

    def _second(self, units: list[str]) -> list[list[int]]:
        """The second vocabulary adds a space of its own, which stands for a unit's first one; a unit without one is coded behind a line feed, which is cut off with that space."""
        told = [u[1:] if u[0] == " " else "\n" + u for u in units]
        coded = self.second.encode(told, num_threads=1) if told else []
        return [[self.space] if u == " " else ids if u[0] == " " else ids[2:] for u, ids in zip(units, coded, strict=True)]

    def _learn(self) -> None:
        units = self.known.new
        self.known.new = []
        a = [self._first(u) for u in units]
        b = self._second(units)
        raw = [u.encode() for u in units]
        join = b"".join
        good = [join(map(self.label_a.__getitem__, x)) == r and join(map(self.label_b.__getitem__, y)) == r for x, y, r in zip(a, b, raw, strict=True)]
        a, b, raw = list(compress(a, good)), list(compress(b, good)), list(compress(raw, good))
        n_a, n_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        ids_a, ids_b = np.fromiter(chain.from_iterable(a), np.int64, int(n_a.sum())), np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        ends_a = np.cumsum([len(self.label_a[k]) for k in ids_a.tolist()], dtype=np.int64)
        ends_b = np.cumsum([len(self.label_b[k]) for k in ids_b.tolist()], dtype=np.int64)
        ends = np.union1d(ends_a, ends_b)
        of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        closes = (ends_a[of_a] == ends) & (ends_b[of_b] == ends) if len(ends) else np.empty(0, bool)
        unit_ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        in_unit = np.searchsorted(unit_ends, ends)
        n_links, n_groups = np.bincount(in_unit, minlength=len(raw)), np.bincount(in_unit[closes], minlength=len(raw))
        told = self._told(ids_a, ids_b, of_a[closes] + 1, of_b[closes] + 1, n_groups)

        good = np.array(good, bool)
        numbers = np.zeros((len(units), 4), np.int64)
        numbers[good] = np.stack([n_a, n_b, n_groups, n_links], 1) if len(raw) else np.empty((0, 4), np.int64)
        said = iter(told)
        self.text += [next(said) if g else "" for g in good.tolist()]
        self.start = np.concatenate([self.start, len(self.pairs) + np.cumsum(numbers[:, 3]) - numbers[:, 3]])
        self.pairs = np.concatenate([self.pairs, ids_a[of_a] * SECOND + ids_b[of_b]])
        self.numbers, self.good = np.concatenate([self.numbers, numbers]), np.concatenate([self.good, good])

    @staticmethod
    def _told(ids_a: np.ndarray, ids_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """The groups of each unit as text: a,a|b;a|b,b"""
        a, b, groups, p, q = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist())), [], 0, 0
        for r, s in zip(upto_a.tolist(), upto_b.tolist(), strict=True):
            groups.append(f"{a[p] if r - p == 1 else ','.join(a[p:r])}|{b[q] if s - q == 1 else ','.join(b[q:s])}")
            p, q = r, s
        out, at = [], 0
        for n in n_groups.tolist():
            out.append(groups[at] if n == 1 else ";".join(groups[at : at + n]))
            at += n
        return out

    def _forget(self) -> None:
        if (stay := self.known.outgrown()) is not None:
            self.pairs = gathered(self.pairs, self.start, self.numbers[:, 3], stay)
            self.numbers, self.good = self.numbers[stay], self.good[stay]
            self.start = np.cumsum(self.numbers[:, 3]) - self.numbers[:, 3]
            self.text = [self.text[k] for k in stay.tolist()]

    def align(self, texts: list[str | None]) -> Iterator[tuple[tuple[int, int, int, int], str | None, np.ndarray, np.ndarray]]:
        """For each text ((n_a, n_b, n_groups, n_links), groups or None where it has no tokens, its pairs, ascending, how often each is linked)."""
        self._forget()
        number, find, met = self.known.__getitem__, self.units.findall, []
        for t in texts:
            units = find(" " + t) if t and SPACE not in t else []
            met.append(np.fromiter(map(number, units), np.int64, len(units)))
        if self.known.new:
            self._learn()
        self.known.touch(np.concatenate(met) if met else np.empty(0, np.int64))
        none = np.empty(0, np.int64)
        for at in met:
            if not len(at) or not self.good[at].all():
                yield (0, 0, 0, 0), None, none, none
                continue
            pairs, n = np.unique(gathered(self.pairs, self.start, self.numbers[:, 3], at), return_counts=True)
            yield tuple(self.numbers[at].sum(0).tolist()), ";".join(map(self.text.__getitem__, at.tolist())), pairs, n


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, np.int64), pa.int64()))


def aligned(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per row: row (its number), id_col, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (its id pairs and how often they are linked) and, with_groups, groups.

    first: a byte-level tokenizer file, which codes a space and the text; second: a file of pieces, which adds that space
    itself. A pair is an id of the first times 2^32 plus one of the second. Both files are broadcast.
    """
    context = docs.sparkSession.sparkContext
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        told = context.broadcast((f.read(), g.read()))  # a few megabytes
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["groups"] * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = coder(f"{first} {second}", lambda: Aligner(*told.value))
        row = TaskContext.get().partitionId() << 33
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            numbers, hashes, pairs, times, groups = [], [], [], [], []
            for n, text, p, t in machine.align(batch.column(1).to_pylist()):
                numbers.append(n)
                hashes.append("" if text is None else hashlib.sha256(text.encode()).hexdigest())
                pairs.append(p)
                times.append(t)
                if with_groups:
                    groups.append(text or "")
            columns = [pa.array(range(row, row + len(hashes)), pa.int64()), batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)]]
            row += len(hashes)
            yield pa.record_batch(columns + [pa.array(hashes), _lists(pairs), _lists(times)] + ([pa.array(groups)] if with_groups else []), names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>" + ", groups string" * with_groups
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of many rows at once: (pair, n), each pair once for about COUNTED of them."""
    pairs, times, held = [], [], 0

    def table() -> pa.RecordBatch:
        found, at = np.unique(np.concatenate(pairs), return_inverse=True)
        return pa.record_batch([pa.array(found), pa.array(np.bincount(at, np.concatenate(times)).astype(np.int64))], names=["pair", "n"])

    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        pairs.append(batch.column(0).flatten().to_numpy())
        times.append(batch.column(1).flatten().to_numpy())
        held += len(pairs[-1])
        if held >= COUNTED:
            yield table()
            pairs, times, held = [], [], 0
    if held:
        yield table()


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how often two ids are linked in all rows."""
    return rows.select("pairs", "times").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """counts with whether no pair of the same second id is more frequent. There are no more second ids than the vocabulary has."""
    second = F.col("pair") % SECOND
    most = counts.groupBy(second.alias("__b")).agg(F.max("n").alias("__most"))
    return counts.join(F.broadcast(most), second == F.col("__b")).select("pair", "n", (F.col("n") == F.col("__most")).alias("best"))


def _hot(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs ascending, counts, best) of all pairs above a count, at most ``most``."""
    by_n = counts.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).limit(most).collect()
    least, held = 0, 0
    for r in by_n:
        if held + r["c"] > most:
            least = r["n"]
            break
        held += r["c"]
    got = counts.where(F.col("n") > least).toArrow().sort_by("pair")
    return tuple(got.column(c).to_numpy() for c in ("pair", "n", "best"))


def alignment(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair is the corpus-wide most frequent one of its id of the second vocabulary, ties included;
    count_sum: over the row's links, how many links of the corpus have the same pair.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = scratch.write(aligned(docs, first, second, id_col, text_col), "aligned", compression="zstd")
    counts = scratch.write(with_best(scratch.write(pair_counts(rows), "counted")), "counts")
    hot = spark.sparkContext.broadcast(_hot(counts, HOT))
    kind = docs.schema[id_col].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = hot.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            pairs, times = batch.column(7).flatten().to_numpy(), batch.column(8).flatten().to_numpy()
            size = batch.column(7).value_lengths().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), size)
            at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            met = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, of[met], times[met] * n[at[met]])
            n_best = np.bincount(of[met], times[met] * best[at[met]], batch.num_rows).astype(np.int64)
            split = np.cumsum(np.bincount(of[~met], minlength=batch.num_rows))[:-1]
            rest = [np.split(x[~met], split) for x in (pairs, times)]
            yield pa.record_batch([*batch.columns[:7], pa.array(n_best), pa.array(total), _lists(rest[0]), _lists(rest[1])], names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "times"])

    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"
    part = scratch.write(rows.withColumnRenamed(id_col, "id").mapInArrow(summed, schema), "summed", compression="zstd")
    scratch.drop("aligned")
    rare = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("m"))
    rare = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("__best"), F.sum(F.col("m") * F.col("n")).alias("__sum"))
    out = part.drop("pairs", "times").join(rare.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row"), "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
