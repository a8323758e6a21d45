"""Vector bin packing of training examples into sequences, by the dot-product heuristic.

A sequence has three limits at once: tokens, segments, tokens that bear loss. Each task
packs its own rows from a pool that is filled while rows come: an open sequence takes,
among the examples of the pool that fit into what is left of all three limits, the one
with the largest dot product of its demands and the room left, both as shares of the
limits and weighted by the pool's demand for each. Examples of equal demands are one
class, so a choice looks at classes. Where cutting is allowed and nothing fits whole, the
room left is filled with the beginning of the example that the heuristic likes best, and
its rest goes back into the pool; what a task has left in the end makes sequences whose
lengths are powers of two, which need no padding. Rows aren't shuffled, and a task that is
run again gives the same sequences.

Defined cases: an example without tokens (null or empty ids) has no piece; an example beyond a limit is cut into
as many pieces as it needs, also where cutting is otherwise not wanted, as nothing may be
dropped; null loss flags, and flags missing at the end, bear loss, a null list of them as well; ids may repeat or
be null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Examples, and sequences' worth of tokens, that a pool holds before sequences are made of them.
POOL_EXAMPLES, POOL_SEQUENCES = 8_192, 64
#: A task's sequences are numbered from its own number times this.
NUMBERS = 1 << 33


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096


class Example:
    """What is left of a row: its ids from ``start`` on, and how much loss they bear up to each."""

    __slots__ = ("row", "ids", "start", "borne")

    def __init__(self, row: int, ids: np.ndarray, start: int, borne: np.ndarray | None):
        self.row, self.ids, self.start, self.borne = row, ids, start, borne

    def demand(self) -> tuple[int, int]:
        """(tokens, tokens that bear loss)"""
        n = len(self.ids) - self.start
        return n, n if self.borne is None else int(self.borne[-1] - self.borne[self.start])

    def fitting(self, tokens: int, loss: int) -> int:
        """Length of the longest beginning within both."""
        n = min(tokens, len(self.ids) - self.start)
        if self.borne is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.borne, self.borne[self.start] + loss, "right")) - 1 - self.start)


class Pool:
    """Examples by class of equal demands."""

    def __init__(self, limits: Limits):
        self.limits, self.held = limits, {}
        self.tokens = self.loss = self.count = 0
        self.stale = True

    def put(self, x: Example) -> None:
        d = x.demand()
        if d not in self.held:
            self.held[d] = []
            self.stale = True
        self.held[d].append(x)
        self.tokens, self.loss, self.count = self.tokens + d[0], self.loss + d[1], self.count + 1

    def _take(self, k: int) -> Example:
        d = self.kinds[k]
        x = self.held[d].pop()
        if not self.held[d]:
            del self.held[d]
            self.live[k] = False
        self.tokens, self.loss, self.count = self.tokens - d[0], self.loss - d[1], self.count - 1
        return x

    def _scores(self, tokens: int, loss: int) -> np.ndarray:
        """Dot products of all classes' demands with the room left. Every example asks for one segment, so that term is the same for all."""
        if self.stale:
            self.kinds = sorted(self.held, reverse=True)
            self.demands = np.array(self.kinds, np.int64).reshape(-1, 2)
            self.live = np.ones(len(self.kinds), bool)
            self.stale = False
        lim = self.limits
        by_tokens = self.tokens / lim.tokens * tokens / lim.tokens / lim.tokens
        by_loss = self.loss / lim.loss * loss / lim.loss / lim.loss
        return np.where(self.live, self.demands[:, 0] * by_tokens + self.demands[:, 1] * by_loss, -1.0)

    def choose(self, tokens: int, loss: int) -> Example | None:
        """The best example that fits whole, taken out."""
        if not self.held:
            return None
        score = self._scores(tokens, loss)
        score[(self.demands[:, 0] > tokens) | (self.demands[:, 1] > loss)] = -1
        k = int(score.argmax())
        return self._take(k) if score[k] >= 0 else None

    def longest(self, tokens: int, loss: int) -> Example | None:
        """The best example whether it fits or not, taken out."""
        return self._take(int(self._scores(tokens, loss).argmax())) if self.held else None


def fill(pool: Pool, tokens: int, cut: bool) -> list[tuple[Example, int]]:
    """One sequence of at most so many tokens: (example, length of the piece from its start on)."""
    lim, out = pool.limits, []
    loss = lim.loss
    while tokens and len(out) < lim.segments:
        x = pool.choose(tokens, loss)
        if x is not None:
            n, borne = x.demand()
            out.append((x, n))
            tokens, loss = tokens - n, loss - borne
            continue
        if not cut or (x := pool.longest(tokens, loss)) is None:
            break
        n = x.fitting(tokens, loss)
        if n == 0:
            pool.put(x)
            break
        rest = Example(x.row, x.ids, x.start + n, x.borne)
        loss -= x.demand()[1] - rest.demand()[1]
        tokens -= n
        out.append((x, n))
        pool.put(rest)
    return out


def tail_sizes(n: int, most: int) -> Iterator[int]:
    """Powers of two up to most that sum up to n, largest first."""
    size = 1 << (most.bit_length() - 1)
    while n:
        if size <= n:
            yield size
            n -= size
        else:
            size >>= 1


def packed(rows: Iterator[tuple[np.ndarray, np.ndarray | None]], limits: Limits, cut: bool) -> Iterator[list[tuple[Example, int]]]:
    """Sequences of the pieces of rows (ids, loss flags or None). Examples refer to rows by their place."""
    pool = Pool(limits)
    for row, (ids, flags) in enumerate(rows):
        if not len(ids):
            continue
        borne = None if flags is None else np.concatenate([[0], np.cumsum(flags)])
        x = Example(row, ids, 0, borne)
        while (d := x.demand())[0] > limits.tokens or d[1] > limits.loss:  # such pieces are whole sequences
            n = x.fitting(limits.tokens, limits.loss)
            yield [(x, n)]
            x = Example(row, ids, x.start + n, borne)
        pool.put(x)
        if pool.count >= POOL_EXAMPLES or pool.tokens >= POOL_SEQUENCES * limits.tokens:
            while pool.count >= POOL_EXAMPLES // 2 or pool.tokens >= POOL_SEQUENCES * limits.tokens // 2:
                yield fill(pool, limits.tokens, cut)
    while pool.count and (not cut or pool.tokens >= limits.tokens):
        yield fill(pool, limits.tokens, cut)
    while pool.count:
        for size in tail_sizes(pool.tokens, limits.tokens):
            if pool.count:
                yield fill(pool, size, cut)


def pack(examples: DataFrame, limits: Limits = Limits(), cut: bool = True, id_col: str = "doc_id", ids_col: str = "ids", loss_col: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens and, with_ids, its ids.

    ids_crc32 is that of the ids as unsigned little-endian 32-bit numbers. Memory holds a pool: at most POOL_EXAMPLES
    rows or POOL_SEQUENCES sequences' worth of tokens, and the row that is read.
    """
    kind = examples.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, tuple] = {}

        def read() -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
            row = 0
            for batch in batches:
                for k in range(batch.num_rows):
                    ids = batch.column(1)[k].values
                    ids = np.empty(0, np.int32) if ids is None else ids.to_numpy(zero_copy_only=False).astype(np.int32)
                    flags = batch.column(2)[k].as_py() if loss_col is not None else None
                    if flags is not None:
                        flags = ([f is not False for f in flags] + [True] * len(ids))[: len(ids)]
                    names[row] = [batch.column(0)[k].as_py(), len(ids)]
                    yield ids.copy(), flags
                    row += 1

        first, left, out = TaskContext.get().partitionId() * NUMBERS, names, []
        for k, pieces in enumerate(packed(read(), limits, cut)):
            at = 0
            for x, n in pieces:
                name, whole = left[x.row]
                ids = x.ids[x.start : x.start + n]
                borne = n if x.borne is None else int(x.borne[x.start + n] - x.borne[x.start])
                out.append((name, x.start, n, zlib.crc32(ids.astype("<u4").tobytes()), whole, first + k, at, borne) + ((ids,) if with_ids else ()))
                at += n
                if x.start + n == whole:
                    del left[x.row]
            if len(out) >= 1_000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0])] + [pa.array(c, pa.int64()) for c in columns[1:8]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[8:]]
        return pa.record_batch(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * with_ids)

    columns = [F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), *([] if loss_col is None else [F.col(loss_col).alias("loss")])]
    return examples.select(*columns).mapInArrow(run, schema).withColumnRenamed("id", id_col)
