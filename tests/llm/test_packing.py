"""Packing against the limits, the library's ids and odd inputs."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rankloom.llm import packing, queries, tokens
from rankloom.llm.packing import Limits

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = ["a", "é", "B", "Σ", "İ", "\n", "\r", " ", "\t", "'s", "'LL", "3", "<|endoftext|>", "<|ENDOFTEXT|>", "中", "ﬁ", "Ǻ", "Å", "́", "　", "\xa0", "\x1c", "\x85", "١", "Ⅷ", "\0", "!?"]


def test_word_ids_equal_the_library(monkeypatch):
    library, draw = Tokenizer.from_file(PATH), random.Random(1)
    with open(PATH, encoding="utf-8") as f:
        words = tokens.WordCoder(f.read())
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    monkeypatch.setattr(tokens, "SLICE", 40)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(60))) for _ in range(1_000)] + ["", None, "x" * 3_000, "Plain words, and more."]
    for at in range(0, len(texts), 50):
        ids, n = words.code(texts[at : at + 50])
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts[at : at + 50]]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [k for x in want for k in x]


def _whole(pieces, of):
    """Checks that pieces cover each row's ids once and sequences keep the limits; returns the sequences' lengths."""
    by_row, by_sequence = {}, {}
    for p in pieces:
        by_row.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["loss_tokens"]))
    assert set(by_row) == set(of)
    for row, found in by_row.items():
        at = 0
        for start, n, crc, whole in sorted(found):
            assert start == at and n > 0 and whole == len(of[row])
            assert crc == zlib.crc32(np.array(of[row][start : start + n], "<u4").tobytes())
            at += n
        assert at == len(of[row])
    for found in by_sequence.values():
        at = 0
        for offset, n, _ in sorted(found):
            assert offset == at
            at += n
    return by_sequence


def test_query_packs_every_id_with_little_padding(spark, sf):
    library = Tokenizer.from_file(PATH)
    docs = queries.table(spark, sf, "documents").collect()
    of = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs}
    sequences = _whole(queries.op13_packing(spark, sf).collect(), of)
    sizes = [sum(n for _, n, _ in s) for s in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes)
    assert max(sizes) <= 4096 and padding <= 0.01 * sum(sizes)
    assert queries.op13_packing(spark, sf).select("sequence_id", "offset", "doc_id").collect() == queries.op13_packing(spark, sf).select("sequence_id", "offset", "doc_id").collect()


def test_three_limits_hold_at_once(spark):
    draw, limits = random.Random(2), Limits(tokens=64, segments=4, loss=24)
    rows = []
    for k in range(600):
        n = draw.choice([1, 2, 3, 9, 30, 64, 150])
        rows.append((k, list(range(n)), None if k % 9 == 0 and n < 20 else [draw.random() < 0.3 for _ in range(n)][: n - k % 2]))
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<boolean>").repartition(3)
    of = {k: ids for k, ids, _ in rows}
    bears = {k: [True] * len(ids) if loss is None else [*loss, *[True] * (len(ids) - len(loss))] for k, ids, loss in rows}
    for cut in (True, False):
        pieces = packing.pack(df, limits, cut=cut, loss_col="loss").collect()
        for p in pieces:
            part = slice(p["start"], p["start"] + p["length"])
            assert p["ids"] == of[p["doc_id"]][part] and p["loss_tokens"] == sum(bears[p["doc_id"]][part])
        for found in _whole(pieces, of).values():
            assert sum(n for _, n, _ in found) <= 64 and len(found) <= 4 and sum(b for _, _, b in found) <= 24
        if not cut:
            parts = {}
            for p in pieces:
                parts[p["doc_id"]] = parts.get(p["doc_id"], 0) + 1
            assert all(n == 1 for k, n in parts.items() if len(of[k]) <= 64 and sum(bears[k]) <= 24)


def test_heuristic_prefers_what_uses_the_room_that_is_left():
    pool = packing.Pool(Limits(tokens=100, segments=10, loss=10))
    for row, (n, borne) in enumerate([(60, 1), (40, 9), (40, 1), (5, 5)]):
        pool.put(packing.Example(row, np.arange(n), 0, np.minimum(np.arange(n + 1), borne)))
    took = [x.row for x, _ in packing.fill(pool, 100, cut=False)]
    assert took == [1, 0]  # tokens and loss are both used up


def test_odd_examples(spark):
    rows = [(1, []), (2, None), (None, [5]), (4, [7, 7]), (4, [7, 7])]
    df = spark.createDataFrame([(i, x, 0, "s") for i, x in rows], "doc_id long, ids array<int>, start int, sequence_id string")
    got = sorted((p["doc_id"] or 0, tuple(p["ids"])) for p in packing.pack(df).collect())
    assert got == [(0, (5,)), (4, (7, 7)), (4, (7, 7))]
    assert packing.pack(df.limit(0)).count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (None, "Ab ab")], "doc_id long, text string")
    ids = {r["doc_id"]: r["ids"] for r in tokens.word_ids(texts, PATH, behind=(2, 3)).collect()}
    assert ids[1] == ids[2] == [2, 3] and len(ids[None]) == 4 and tokens.word_ids(texts.limit(0), PATH).count() == 0
