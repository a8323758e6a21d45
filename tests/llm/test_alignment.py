"""Alignment of two vocabularies against whole texts coded by both libraries and all overlaps by comparison."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import alignment, queries, tokens
from rankloom.llm.bpe import byte_letters

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = ["a", "é", "The", "\n", "\r", " ", "  ", "\t", "'s", "!", ";", ")", "3", "<|endoftext|>", "<s>", "</s>", "中", "ﬁ", "Ǻ", "　", "\xa0", "\x1c", "\x85", "۰", "\0", "😀", " "]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=SECOND)


def plain(texts: list[tuple], libraries) -> dict:
    """doc_id -> the contract's columns: spans of whole texts, compared token by token."""
    first, second = libraries
    letters, names = byte_letters(), {k: s for s, k in first.get_vocab().items()}
    out, links = {}, {}
    for doc, text in texts:
        links[doc], spans = [], []
        if text:
            a = [(k, bytes(letters[c] for c in names[k])) for k in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(k, bytes([int(s[3:5], 16)]) if second.is_byte(k) else s.replace("▁", " ").encode()) for k in second.encode(text) for s in [second.id_to_piece(k)]]
            for tokens_ in (a, b):
                at, here = 0, []
                for k, s in tokens_:
                    here.append((k, at, at + len(s)))
                    at += len(s)
                spans.append(here)
            if any(b"".join(s for _, s in x) != (" " + text).encode() for x in (a, b)):
                spans = []
        if not spans:
            out[doc] = [0, 0, 0, 0, ""]
            continue
        a, b = spans
        j = 0
        for k, low, high in a:
            while b[j][2] <= low:
                j += 1
            m = j
            while m < len(b) and b[m][1] < high:
                links[doc].append((k, b[m][0]))
                m += 1
        shared = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, begin = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(k) for k, low, high in x if begin <= low and high <= e) for x in (a, b)) if len(a) < 400 else None)
            begin = e
        told = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out[doc] = [len(a), len(b), len(shared), len(links[doc]), told]
    count = collections.Counter(p for x in links.values() for p in x)
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return {doc: (*v[:4], sum(count[p] == most[p[1]] for p in links[doc]), sum(count[p] for p in links[doc]), v[4]) for doc, v in out.items()}


def rows_of(df) -> dict:
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()}


def same(got: dict, want: dict) -> None:
    assert set(got) == set(want)
    for doc, w in want.items():
        assert got[doc][:6] == w[:6] and (w[6] is None or got[doc][6] == w[6]), doc


@pytest.mark.parametrize("hot", [0, 30, 200_000])
def test_odd_texts(spark, libraries, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    monkeypatch.setattr(alignment, "COUNTED", 500)
    draw = random.Random(hot)
    texts = [(k, "".join(draw.choice(LETTERS) for _ in range(draw.randrange(50)))) for k in range(400)]
    texts += [(400, None), (401, ""), (402, "a▁b"), (403, "word " * 3_000), (404, "x" * 5_000), (405, " "), (406, " \n a"), (407, "\r\n")] + [(500 + k, "the same words, twice") for k in range(5)]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in texts], "doc_id long, text string, row long, pairs string").repartition(3)
    same(rows_of(alignment.alignment(df, FIRST, SECOND)), plain(texts, libraries))


def test_query_equals_plain_reading(spark, sf, libraries):
    texts = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]
    same(rows_of(queries.op11_alignment(spark, sf)), plain(texts, libraries))


def test_units_are_remembered_anew(monkeypatch, libraries):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    with open(FIRST, encoding="utf-8") as f, open(SECOND, "rb") as g:
        machine = alignment.Aligner(f.read(), g.read())
    draw = random.Random(5)
    for _ in range(20):
        texts = [(k, " ".join(draw.choice(["red", "green", "bl\nue", "ünder", "x1", "(y)", "Zebra's"]) + str(draw.randrange(9)) for _ in range(20))) for k in range(10)]
        want = plain(texts, libraries)
        for (k, _), (numbers, told, _, _) in zip(texts, machine.align([t for _, t in texts]), strict=True):
            assert numbers == want[k][:4] and hashlib.sha256(told.encode()).hexdigest() == want[k][6]


def test_groups_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "hello"), (1, None), (1, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in alignment.aligned(df, FIRST, SECOND, with_groups=True).collect()}
    assert got[1] == "" and got[None].count("|") == got[None].count(";") + 1
    assert alignment.alignment(df.limit(0), FIRST, SECOND).count() == 0
    assert sorted(alignment.alignment(df, FIRST, SECOND).select(F.coalesce("doc_id", F.lit(0)), "n_links").collect()) [1:] == [(1, 0), (1, 0)]
