"""Token ids of whole texts by the tokenizers library, with units of text remembered.

A text is cut where white space stands, at places that no token crosses, so the ids of a
text are those of its units one after the other. A unit is coded when it is first met and
remembered by its number; a batch of texts is then a gather from flat arrays. Units of
plain Latin letters are coded part by part with the library's model; any other unit goes
through the whole library, normaliser and special tokens included.

Defined cases: null and empty texts have no ids, besides those asked to stand behind every
text; an empty table gives no rows; ids may repeat or be null, each row is coded by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters

#: Units and bytes of units that a worker remembers; then it begins anew.
REMEMBERED, REMEMBERED_BYTES = 400_000, 64 << 20
#: Rows that are coded at once, and bytes of one text that are cut into units at once.
ROWS, SLICE = 256, 4 << 20
#: Fixed value: the split of the vocabulary with word ends, in lower case.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that every Unicode version treats alike: composed, one letter in lower case, no white space.
PLAIN = re.compile("[!-~¡-įı-ɏ]+")


class Numbered(dict):
    """unit -> its number; units not met before wait in ``new`` until they are coded."""

    def __init__(self):
        super().__init__()
        self.new, self.bytes, self.used, self.now = [], 0, np.empty(0, np.int32), 0

    def __missing__(self, unit):
        self[unit] = k = len(self)
        self.new.append(unit)
        self.bytes += len(unit)
        return k

    def touch(self, at: np.ndarray) -> None:
        """Note that these numbers are in use now."""
        self.now += 1
        self.used = np.concatenate([self.used, np.zeros(len(self) - len(self.used), np.int32)])
        self.used[at] = self.now

    def outgrown(self) -> np.ndarray | None:
        """Where too much is remembered: the old numbers of the units that stay, those used last, in their new order."""
        if len(self) <= REMEMBERED and self.bytes <= REMEMBERED_BYTES:
            return None
        stay = np.sort(np.argsort(self.used, kind="stable")[-(REMEMBERED // 2) :]) if self.bytes <= REMEMBERED_BYTES else np.empty(0, np.int64)
        units = list(self)
        self.clear()
        self.bytes = 0
        for k, old in enumerate(stay.tolist()):
            self[units[old]] = k
            self.bytes += len(units[old])
        self.used = self.used[stay]
        return stay


def letters_of() -> list[str]:
    """The letter of a byte-level vocabulary for each byte."""
    back = {b: c for c, b in byte_letters().items()}
    return [back[b] for b in range(256)]


class Parts(dict):
    """part of a unit -> its ids by the library's model."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, dict(enumerate(letters_of()))

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = tuple([t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))])
        if len(part) <= 64:
            if len(self) > REMEMBERED // 2:
                self.clear()
            self[part] = ids
        return ids


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + size] of the numbered units, one after the other."""
    n = size[at]
    first = np.cumsum(n) - n
    return flat[np.repeat(start[at] - first, n) + np.arange(int(n.sum()))]


class WordCoder:
    """Ids by a tokenizer that drops white space, as the library gives them without special tokens added around a text."""

    def __init__(self, told: str):
        self.library = Tokenizer.from_str(told)
        self.library.no_truncation()
        self.library.no_padding()
        self.parts, self.split, self.known = Parts(self.library.model), regex.compile(WORD_SPLIT), Numbered()
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, unit: bytes) -> tuple[int, ...] | list[int]:
        if unit.isalpha():
            return self.parts[unit.lower().decode()]
        text = unit.decode()
        if "<|" not in text and PLAIN.fullmatch(text):
            text = text.lower()
            return self.parts[text] if text.isalpha() else [k for p in self.split.findall(text) for k in self.parts[p]]
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self) -> None:
        ids = [self._ids(u) for u in self.known.new]
        self.known.new = []
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])

    def code(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the texts one after the other, how many each has); units are cut from a very long text slice by slice."""
        if (stay := self.known.outgrown()) is not None:
            self.flat = gathered(self.flat, self.start, self.size, stay)
            self.size = self.size[stay]
            self.start = np.cumsum(self.size) - self.size
        number, met, n = self.known.__getitem__, [], []
        for text in texts:
            data, n_units = (text or "").encode(), 0
            for part in [data] if len(data) <= SLICE else slices(data):
                units = part.split()
                met.append(np.fromiter(map(number, units), np.int32, len(units)))
                n_units += len(units)
            n.append(n_units)
        if self.known.new:
            self._learn()
        at = np.concatenate(met) if met else np.empty(0, np.int32)
        self.known.touch(at)
        text_of = np.repeat(np.arange(len(n)), n)
        return gathered(self.flat, self.start, self.size, at), np.bincount(text_of, self.size[at], len(n)).astype(np.int64)


def slices(data: bytes) -> Iterator[bytes]:
    """data in parts of about SLICE bytes, each but the last ending before white space."""
    at, white = 0, re.compile(rb"[ \t-\r]")
    while at < len(data):
        end = white.search(data, min(at + SLICE, len(data)))
        end = end.start() if end else len(data)
        yield data[at:end]
        at = end


_CODERS: dict[str, object] = {}


def coder(key: str, make: Callable[[], object]):
    """The worker's coder of this key, made once; one of another key takes its place."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = make()
    return _CODERS[key]


def word_ids(docs: DataFrame, path: str, behind: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): one row per row, the ids of its whole text and then those of ``behind``.

    The vocabulary (bounded by its file) is broadcast as text, so the file is read on the driver only.
    """
    with open(path, encoding="utf-8") as f:
        told = docs.sparkSession.sparkContext.broadcast(f.read())  # a few megabytes
    kind = docs.schema[id_col].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = coder(path, lambda: WordCoder(told.value)), np.array(behind, np.int32)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            got, n = words.code(batch.column(1).to_pylist())
            ends = np.cumsum([0, *n])
            got = np.insert(got, np.repeat(ends[1:], len(last)), np.tile(last, len(n)))
            ends = (ends + len(last) * np.arange(len(ends))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(got.astype(np.int32)))
            yield pa.record_batch([batch.column(0), ids], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(code, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
