"""The trie against a dictionary of prefixes, in blocks of all sizes, and its query against SQL."""

import collections
import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.llm import prefix_trie, queries

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(turns: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    """The nodes of rebuilt conversations, by a dictionary of all prefixes."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for conv, said in sorted(turns.items()):
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(conv)
        ends[tuple(said)].append(conv)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, inside in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(inside) - 1) * (len(p[-1][1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return {(m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in members.items()}


def rebuilt(turns: dict[int, list]) -> dict[int, list]:
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def rows_of(df):
    got = [tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed, size, partitions", [(1, 1, 5), (2, 3, 4), (3, 7, 1), (4, 10_000, 3)])
def test_nodes_equal_a_dictionary_of_prefixes(spark, monkeypatch, seed, size, partitions):
    draw = random.Random(seed)
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", size)
    convs = {c: [(draw.choice("ua"), "x" * draw.choice([1, 1, 2, 3])) for _ in range(draw.choice([0, 1, 2, 3, 3, 9]))] for c in draw.sample(range(-5, 5_000), 120)}
    for c in list(convs)[:40]:
        convs[c] = convs[list(convs)[0]]
    rows = [(c, k, r, t) for c, said in convs.items() for k, (r, t) in enumerate(said)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turns = prefix_trie.ordered_turns(df)
    blank = spark.createDataFrame([(c,) for c, said in convs.items() if not said], "conv_id long")
    turns = turns.unionByName(blank.withColumn("turns", F.array().cast(turns.schema["turns"].dataType)))
    whole = prefix_trie.trie
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(whole(turns)) == plain(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_equals_plain_reading_and_sql(spark, sf):
    turns = collections.defaultdict(list)
    for r in sorted(queries.table(spark, sf, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    got = rows_of(queries.op12_prefix_trie(spark, sf))
    assert got == plain(rebuilt(turns))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS FROM '{os.path.join(sf, 'conversations.parquet')}'")
    assert {tuple(r) for r in db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.OP12_SQL})").fetchall()} == got


def test_odd_conversations(spark, tmp_path):
    rows = [(1, None, None, None, "x"), (1, 0, "user", "a", "x"), (2, 5, "", "", "x"), (2, 5, "user", "a", "x"), (None, 0, "user", "a", "x"), (107, 0, "user", "é" * 70_000, "x"), (107, 0, "user", "é" * 70_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(queries.op12_prefix_trie(spark, str(tmp_path)))
    tie = lambda x: hashlib.sha256(f"{len(x[0])}:{x[0]}{x[1]}".encode()).hexdigest()
    turns = {1: [("", ""), ("user", "a")], 2: sorted([("", ""), ("user", "a")], key=tie), 107: [("user", "é" * 70_000)] * 2}
    assert got == plain(rebuilt(turns))
    assert prefix_trie.trie(prefix_trie.ordered_turns(df.limit(0))).count() == 0
