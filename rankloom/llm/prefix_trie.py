"""The trie of conversations' common beginnings, from their sorted order.

Conversations are sorted by their turns (digests of role and text) over range partitions;
with each stands how many turns it shares with the one before it, its LCP. The trie is the
Cartesian tree of these numbers: a node is a run of conversations whose LCPs stay at or
above its depth, and ends where the nearest smaller value stands on either side. Rows are
cut into blocks. Each block finds its own nearest smaller values with a stack; runs that leave
a block are completed by the minima of the blocks before it, two numbers for each block.
Equal LCPs of a run are one node, and the depths between a node and its parent, which
nothing branches at, are expanded. All figures of a node are sums over its run (or minima),
so blocks are aggregated apart and only the runs that cross blocks are added up.

A turn is known by 128 bits of a SHA-256 of role and text; texts aren't moved. All digests
of one conversation meet in one row (16 bytes a turn), those of different conversations
never do. The ids that end at one node are hashed as they stream by in their order, as a SHA-256
has no parts that could be made apart; nothing holds them at once.

Defined cases: null roles and texts count as empty; turns are ordered by turn (null first), then by digest;
repeated rows are turns of their own; rows without a conversation id belong to none and are left out; an empty
table has no conversations, so not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, if_few, text_or_empty

#: Conversations and turns of a block at most (one conversation at least).
BLOCK_ROWS, BLOCK_TURNS = 16_384, 262_144
#: Characters of a turn's digest in a key.
WIDTH = 32

BLOCKS = "part int, chunk int, convs array<long>, depths array<int>, chars array<int>, lcp array<int>, least int, first string, last string"
SUMS = ("n_convs", "n_children", "n_leaves", "total", "distinct")
NODES = "done boolean, block long, q long, depth long, smallest long, parent_conv_id long, parent_block long, above long, " + ", ".join(f"{s} long" for s in SUMS) + ", ends binary"


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns in order as (turn, digest, chars)."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col(turn_col).alias("turn"), F.substring(F.sha2(said, 256), 1, WIDTH).alias("digest"), F.length(text).alias("chars"))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("x")).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def with_shared_start(turns: DataFrame, donor: Column, n: Column, most: int) -> DataFrame:
    """turns whose first ``n`` (at most ``most``) are those of the conversation ``donor``, all if it has fewer, none if it is absent; then come its own after its first n."""
    heads = turns.select(F.col("conv_id").alias("__donor"), F.slice("turns", 1, most).alias("__head"))
    both = turns.withColumn("__n", n).withColumn("__of", donor).join(heads, F.col("__of") == F.col("__donor"), "left")
    head = F.slice(F.coalesce("__head", F.array().cast(turns.schema["turns"].dataType)), F.lit(1), F.col("__n"))
    own = F.slice("turns", F.col("__n") + 1, F.greatest(F.size("turns") - F.col("__n"), F.lit(0)))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def shared_turns(a: str, b: str) -> int:
    """How many digests two keys begin with alike."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    return k // WIDTH


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, key, chars) as blocks; the first LCP of a partition is -1 until its neighbour is known."""
    part, chunk, before = TaskContext.get().partitionId(), 0, None
    convs, depths, chars, lcp, first = [], [], [], [], None

    def block(last: str) -> pa.RecordBatch:
        values = [part, chunk, convs, depths, chars, lcp, min(lcp[1:], default=1 << 30), first, last]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.int32(), pa.string(), pa.string()]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "chunk", "convs", "depths", "chars", "lcp", "least", "first", "last"])

    for batch in batches:
        for conv, key, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if convs and (len(convs) >= BLOCK_ROWS or len(chars) + len(said) > BLOCK_TURNS):
                yield block(before)
                chunk += 1
                convs, depths, chars, lcp = [], [], [], []
            if not convs:
                first = key
            convs.append(conv)
            depths.append(len(said))
            chars += said
            lcp.append(-1 if before is None else shared_turns(before, key))
            before = key
    if convs:
        yield block(before)


def nearest_smaller(lcp: list[int]) -> tuple[list[int], list[int]]:
    """(left, right): the places of the nearest strictly smaller values, -1 and len(lcp) where there are none."""
    n, stack = len(lcp), []
    left, right = [-1] * n, [n] * n
    for k, v in enumerate(lcp):
        while stack and lcp[stack[-1]] > v:
            right[stack.pop()] = k
        if stack:
            left[k] = left[stack[-1]] if lcp[stack[-1]] == v else stack[-1]
        stack.append(k)
    return left, right


def runs(depths: list[int], lcp: list[int], right: list[int]) -> np.ndarray:
    """(place, lowest depth, greatest depth, end): the nodes of a block that begin at each place, those of consecutive depths with one end as one row.

    The first row has all depths, those that it shares with the block before too. Runs end with the block.
    """
    n, out = len(lcp), []
    for k in range(n):
        low, high, j = (lcp[k] if k else -1), depths[k], k + 1
        while high > low:
            v = lcp[j] if j < n else -1
            floor = max(v, low)
            if high > floor:
                out.append((k, floor + 1, high, j - 1))
                high = floor
            j = right[j] if j < n else n
    return np.array(out, np.int64).reshape(-1, 4)


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low:high + 1], from minima over powers of two."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        a, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(a[:-step], a[step:]))
    level = np.frexp(high - low + 1)[1] - 1
    out = np.empty(len(low), values.dtype)
    for k, a in enumerate(levels):
        here = level == k
        out[here] = np.minimum(a[low[here]], a[high[here] + 1 - (1 << k)])
    return out


def block_nodes(q: int, convs: np.ndarray, depths: np.ndarray, chars: np.ndarray, lcp: np.ndarray, minima: np.ndarray, after: int) -> dict:
    """The nodes of a block, columns of NODES. lcp[0] is the LCP with the block before, after that with the next block (-1: there is none)."""
    n = len(convs)
    left, right = nearest_smaller(lcp.tolist())
    run = runs(depths.tolist(), lcp.tolist(), right)
    times = run[:, 2] - run[:, 1] + 1
    low, high = np.repeat(run[:, 0], times), np.repeat(run[:, 3], times)
    depth = np.repeat(run[:, 1], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    came, goes = (low == 0) & (depth <= lcp[0]), (high == n - 1) & (depth <= after)

    text = np.concatenate([[0], np.cumsum(chars)])
    row = np.cumsum(depths) - depths
    upto = lambda k, d: text[row[k] + d] - text[row[k]]  # characters of a row's first d turns
    total = upto(np.arange(n), depths)
    own = total - upto(np.arange(n), np.maximum(lcp, 0))
    summed = lambda x: np.concatenate([[0], np.cumsum(x)])
    of_run = lambda s: s[high + 1] - s[low]
    above = upto(low, np.maximum(depth - 1, 0))
    distinct = np.where(came, of_run(summed(own)), of_run(summed(own)) - own[low] + total[low] - above)
    later = np.append(lcp[1:], after)

    def counted(rows: np.ndarray, value: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """How many of the rows between inside (exclusive) and the run's end have depth as their value."""
        keys = np.sort(value[rows] * (n + 1) + rows + 1)
        return np.searchsorted(keys, depth * (n + 1) + high + 1, "right") - np.searchsorted(keys, depth * (n + 1) + inside + 1, "right")

    places = np.arange(n)
    branching = places[depths > lcp]
    children = counted(branching, lcp, low) + np.where(came, (lcp[0] == depth) & (depths[0] > depth), depths[low] > depth)
    n_ends = counted(places, depths, low - 1)

    smallest = _least(convs, low, high)
    # The parent is the run of depth - 1 around the first row.
    code = low * (int(depths.max(initial=0)) + 2) + depth
    order = np.argsort(code)
    begin = np.where((depth - 1 > lcp[low]) | (low == 0), low, np.maximum(np.array(left)[low], 0))
    up = order[np.minimum(np.searchsorted(code[order], begin * (int(depths.max(initial=0)) + 2) + depth - 1), len(order) - 1)]
    falling = np.minimum.accumulate(minima[:q][::-1]) if q else np.empty(0, np.int64)
    block = np.where(came, q - 1 - np.searchsorted(-falling, -depth, "right"), q)
    crosses = came | goes

    names, ends = [str(c) for c in convs.tolist()], []
    for k, e, open_ in zip(low.tolist(), n_ends.tolist(), crosses.tolist(), strict=True):
        told = ",".join(names[k : k + e]).encode()
        ends.append(told if open_ else hashlib.sha256(told).hexdigest().encode())
    root = depth == 0
    return {
        "done": ~crosses,
        "block": block,
        "q": np.full(len(low), q),
        "depth": depth,
        "smallest": smallest,
        "parent_conv_id": np.ma.array(smallest[up], mask=root | crosses[up]),
        "parent_block": np.ma.array(block[up], mask=root | ~crosses[up]),
        "above": above,
        "n_convs": high - low + 1,
        "n_children": children,
        "n_leaves": of_run(summed(later < depths)),
        "total": of_run(summed(total)),
        "distinct": distinct,
        "ends": ends,
    }


def _nodes(told):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lcps, minima = told.value
        for batch in batches:
            for part, chunk, *lists in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                q = place[part] + chunk
                convs, depths, chars, lcp = (np.array(x, np.int64) for x in lists)
                lcp[0] = lcps[q]
                got = block_nodes(q, convs, depths, chars, lcp, minima, int(lcps[q + 1]) if q + 1 < len(lcps) else -1)
                kinds = [pa.bool_(), *[pa.int64()] * (len(got) - 2), pa.binary()]
                arrays = [pa.array(v.data, k, mask=np.ma.getmaskarray(v)) if isinstance(v, np.ma.MaskedArray) else pa.array(v, k) for v, k in zip(got.values(), kinds, strict=True)]
                table = pa.Table.from_arrays(arrays, names=list(got))
                yield from table.to_batches(max_chunksize=8_192)

    return nodes


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, depth, ends) rows in order -> (block, depth, digest): their texts joined by commas, hashed one after the other."""
    at, h, out = None, None, []
    for batch in batches:
        for block, depth, told in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at == (block, depth):
                h.update(b",")
            else:
                if at is not None:
                    out.append((*at, h.hexdigest()))
                at, h = (block, depth), hashlib.sha256()
            h.update(told)
    if at is not None:
        out.append((*at, h.hexdigest()))
    if out:
        yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["block", "depth", "digest"])


def trie(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: (conv_id long, turns array of (digest, chars)), a row for each. n_leaves counts the childless nodes of the
    subtree, saved_tokens adds up (members - 1) x characters of the last turn over it, ends_sha256 is of the ids of the
    conversations that end here, ascending, joined by commas.

    The driver and every task hold two numbers for each block of up to BLOCK_ROWS conversations, and the driver the first
    and last key of each partition.
    """
    spark = conversations.sparkSession
    scratch = scratch or Scratch(spark)
    key = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    blocks = scratch.write(rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_blocks, BLOCKS), "blocks")
    edges = {r["part"]: (r["first"], r["last"]) for r in blocks.groupBy("part").agg(F.min_by("first", "chunk").alias("first"), F.max_by("last", "chunk").alias("last")).collect()}
    place, lcps, minima, before = {}, [], [], None
    for r in sorted(blocks.select("part", "chunk", "least", F.get("lcp", F.lit(0)).alias("lcp")).collect()):
        if r["chunk"] == 0:
            place[r["part"]] = len(lcps)
        shared = r["lcp"] if r["chunk"] else -1 if before is None else shared_turns(edges[before][1], edges[r["part"]][0])
        before = r["part"]
        lcps.append(shared)
        minima.append(min(shared, r["least"]))
    told = spark.sparkContext.broadcast((place, np.array(lcps, np.int64), np.array(minima, np.int64)))
    found = scratch.write(blocks.select("part", "chunk", "convs", "depths", "chars", "lcp").mapInArrow(_nodes(told), NODES), "nodes")

    pieces = found.where("NOT done")
    crossing = pieces.groupBy("block", "depth").agg(F.min("smallest").alias("smallest"), F.min("parent_block").alias("parent_block"), F.max("above").alias("above"), *[F.sum(s).alias(s) for s in SUMS])
    ends = pieces.where("length(ends) > 0").select("block", "depth", "ends", "q").repartition("block", "depth").sortWithinPartitions("block", "depth", "q")
    digests = ends.select("block", "depth", "ends").mapInArrow(_hashed, "block long, depth long, digest string")
    crossing = scratch.write(crossing.join(digests, ["block", "depth"], "left"), "crossing")  # a row for each depth of each block's last conversation at most
    named = if_few(crossing.select(F.col("block").alias("parent_block"), (F.col("depth") + 1).alias("depth"), F.col("smallest").alias("__parent")))

    saved = (F.col("total") - F.col("n_convs") * F.col("above") - F.col("distinct")).alias("saved_tokens")
    whole = found.where("done").select("depth", "smallest", "parent_conv_id", "parent_block", "n_convs", "n_children", "n_leaves", saved, F.col("ends").cast("string").alias("ends_sha256"))
    across = crossing.select(
        "depth", "smallest", F.lit(None).cast("long").alias("parent_conv_id"), "parent_block", "n_convs", "n_children", "n_leaves", saved, F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
    nodes = whole.unionByName(across)
    known = nodes.where("parent_block IS NULL").withColumn("__parent", F.lit(None).cast("long"))
    asked = nodes.where("parent_block IS NOT NULL").join(named, ["parent_block", "depth"])
    return known.unionByName(asked).select(
        F.col("smallest").alias("conv_id"), "depth", F.coalesce("parent_conv_id", "__parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
