"""Byte-level BPE by a deterministic tokenization automaton.

The automaton accepts exactly the token sequences that merging in rank order
yields. It is grown from one state with a loop for each byte by one gadget for each
merge (u, v) -> uv: where u leads to a state q that v may leave, u is redirected to
a copy of q without v, and uv is added beside every u, leading where v leads. All
arcs of a token then lead to one state, and a state is its parent without one
token plus what later merges add beside tokens it has; so a transition is looked up
through those few records and remembered in a table. Every prefix of a word has one
accepted path, hence a place in a word is reached in one state; decoding emits the
arcs' labels.

Words come from the usual split of byte-level vocabularies. Special tokens in a text
are cut out first. Defined cases: null and empty texts have no tokens; an empty table
gives no rows; ids may repeat or be null, each row is encoded by itself.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Fixed value: the split of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens a worker remembers, twice; most words of a large corpus are met once, so more of them take memory and save no time.
REMEMBERED = 60_000
#: Rows whose ids are held at once, and remembered transitions.
ROWS, STEPS = 256, 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file -> the byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Compiled from a vocabulary (letters -> id) and its ranked merges."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]):
        letters = byte_letters()
        size = max([*vocab.values(), *special.values()], default=0) + 1
        self.label = [b""] * size
        for name, k in vocab.items():
            self.label[k] = bytes(letters[c] for c in name)
        for name, k in special.items():
            self.label[k] = name.encode()
        self.special = special
        self.parent, self.without, self.made = [-1], [-1], [-1]
        self.target, self.left, self.birth = [0] * size, [-1] * size, [-1] * size
        self.step: dict[int, int] = {}
        self.size = size
        alive = {vocab[c] for c in letters if c in vocab}
        for rank, pair in enumerate(merges):
            u, v = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            uv = vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            q = self.target[u]
            if u not in alive or v not in alive or not self.may(q, v):
                continue
            after = self.target[v]  # where v leads before u is redirected
            self.parent.append(q)
            self.without.append(v)
            self.made.append(rank)
            self.target[u] = len(self.parent) - 1
            self.target[uv], self.left[uv], self.birth[uv] = after, u, rank
            alive.add(uv)
        self.step.clear()
        self.parent, self.without, self.made, self.target, self.left, self.birth = (array("i", x) for x in (self.parent, self.without, self.made, self.target, self.left, self.birth))
        self.tree: dict[int, int] = {}  # node * 256 + byte -> node; one table takes less than one for each node
        self.ends = array("i", [-1])
        for k in alive:
            node = 0
            for b in self.label[k]:
                to = self.tree.setdefault(node << 8 | b, len(self.ends))
                if to == len(self.ends):
                    self.ends.append(-1)
                node = to
            self.ends[node] = k
        self.longest = max(map(len, self.label), default=1)

    def may(self, state: int, token: int) -> bool:
        """Whether the token leaves the state."""
        while True:
            if self.birth[token] >= self.made[state]:
                if self.left[token] < 0:
                    return True
                token = self.left[token]
            elif token == self.without[state]:
                return False
            else:
                state = self.parent[state]

    def _arcs(self, word: bytes, at: int) -> list[int]:
        """The tokens that the word goes on with at a place, shortest first."""
        tree, ends, node, out = self.tree, self.ends, 0, []
        for b in word[at : at + self.longest]:
            node = tree.get(node << 8 | b)
            if node is None:
                break
            if ends[node] >= 0:
                out.append(ends[node])
        return out

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-split word.

        Follows the longest token that the state has an arc for and steps back where there is none. A place
        is reached in one state only, so a place that was left in vain is never entered again.
        """
        n, label, step, size = len(word), self.label, self.step, self.size
        at, state, out, dead = 0, 0, [], set()
        states, arcs = [0], [self._arcs(word, 0)]
        while at < n:
            open_arcs = arcs[-1]
            while open_arcs:
                token = open_arcs.pop()
                to = at + len(label[token])
                if to in dead:
                    continue
                key = state * size + token
                then = step.get(key)
                if then is None:
                    if len(step) > STEPS:
                        step.clear()
                    then = step[key] = self.target[token] if self.may(state, token) else -1
                if then >= 0:
                    at, state = to, then
                    out.append(token)
                    states.append(then)
                    arcs.append(self._arcs(word, at) if at < n else [])
                    break
            else:
                dead.add(at)
                states.pop()
                arcs.pop()
                at -= len(label[out.pop()])
                state = states[-1]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


class _Remembered(dict):
    """word -> its ids joined by commas. Words whose ids don't decode to their own bytes are in ``odd`` with what they decode to."""

    def __init__(self, machine: Automaton):
        self.machine, self.older, self.odd = machine, {}, {}

    def __missing__(self, word: str) -> str:
        out = self.older.get(word)
        if out is None:
            raw = word.encode()
            ids = self.machine.encode(raw)
            out, told = ",".join(map(str, ids)), self.machine.decode(ids)
            if told != raw:
                self.odd[word] = told
        if len(word) <= 64:
            if len(self) > REMEMBERED:  # words in use move on from the older half, the others go
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


def load(path: str) -> tuple[dict, list, dict]:
    """Vocabulary, merges and special tokens of a tokenizer file; read once, on the driver.

    Special tokens are cut out of a text as they stand; a file that wants more of them (white space around them
    taken in, whole words only, normalised text) is an error.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    for t in told.get("added_tokens", []):
        if any(t.get(flag) for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"special token with flags: {t['content']}")
    return told["model"]["vocab"], told["model"]["merges"], {t["content"]: t["id"] for t in told.get("added_tokens", [])}


def packed(path: str) -> bytes:
    """load(path) as bytes: what is broadcast, and unpacked where the automaton is compiled."""
    return zlib.compress(json.dumps(load(path)).encode(), 1)


def _machine(key: str, parts: bytes) -> tuple[Automaton, _Remembered]:
    def make() -> tuple[Automaton, _Remembered]:
        machine = Automaton(*json.loads(zlib.decompress(parts)))
        return machine, _Remembered(machine)

    return kept(("bpe", key), make)


def pieces(text: str, special: dict[str, int], split=regex.compile(SPLIT)) -> Iterator[tuple[str, bool]]:
    """The words of a text and the special tokens between them, (string, is special)."""
    if special and any(s in text for s in special):
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        for k, part in enumerate(cut.split(text)):
            if k % 2:
                yield part, True
            else:
                for w in split.findall(part):
                    yield w, False
    else:
        for w in split.findall(text):
            yield w, False


def _coder(parts, key: str, with_ids: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = _machine(key, parts.value)
        split, special = regex.compile(SPLIT), machine.special
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            counts, ids, hashes, back = [], [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                if special and any(s in text for s in special):
                    found = list(pieces(text, special, split))
                    joined = ",".join([str(special[w]) if is_special else known[w] for w, is_special in found])
                    words = [w for w, _ in found]
                else:
                    words = split.findall(text)
                    joined = ",".join(map(known.__getitem__, words))
                counts.append(joined.count(",") + 1 if words else 0)
                hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                told = "".join(words).encode() if not known.odd else b"".join([known.odd.get(w) or w.encode() for w in words]).decode("utf-8", "replace").encode()
                back.append(hashlib.sha256(told).hexdigest())
                if with_ids:
                    ids.append(np.array(joined.split(",") if joined else [], np.int32))
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(back)]
            yield pa.record_batch(out + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return code


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row: id_col, n_tokens, ids_sha256, decoded_sha256 and, with_ids, the ids.

    The vocabulary (bounded by its file) is broadcast; each worker compiles it once.
    """
    parts = docs.sparkSession.sparkContext.broadcast(packed(path))  # a megabyte or two
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_coder(parts, path, with_ids), schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the texts that lists of ids stand for; a null list gives the empty text."""
    parts = tokens.sparkSession.sparkContext.broadcast(packed(path))  # a megabyte or two
    kind = tokens.schema[id_col].dataType.simpleString()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = _machine(path, parts.value)
        for batch in batches:
            texts = [machine.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(back, f"id {kind}, text string").withColumnRenamed("id", id_col)
