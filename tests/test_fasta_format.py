"""The fasta format against a plain reading of the same bytes, whatever the ranges."""

import gzip
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.operators import ordering  # noqa: F401
from rankloom.sources import fasta, fasta_format


@pytest.fixture(scope="module")
def fmt(spark):
    spark.dataSource.register(fasta_format.FastaSource)
    return spark


def plain(data: bytes) -> list[tuple]:
    out, at = [], 0
    for line in data.split(b"\n"):
        if line[:1] == b">":
            out.append([at, line[1:].rstrip(b"\r").decode(), ""])
        elif out:
            out[-1][2] += "".join(line.decode().split())
        at += len(line) + 1
    return [tuple(r) for r in out]


LINES = st.lists(st.sampled_from([">", ">a b", ">{1}G1~x d__é", "ACGT", "AC>GT", "", " AC GT ", "A" * 40, ">>"]), max_size=12)


@given(LINES, st.sampled_from(["\n", "\r\n"]), st.booleans(), st.integers(1, 60))
@settings(max_examples=400, deadline=None)
def test_ranges_hold_each_record_once(lines, end, closed, split):
    data = (end.join(lines) + (end if closed else "")).encode()
    for whole in (True, False):
        got = [r for k in range(0, len(data), split) for r in fasta_format.scanned(io.BytesIO(data), k, min(k + split, len(data)), whole)]
        assert got == [(a, h, s if whole else "") for a, h, s in plain(data)]


def test_read_folder(fmt, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    data = b"".join(b">{%d}G%d~x\nACGT\nAC\n" % (k, k) for k in range(1, 400))
    (folder / "a.fasta").write_bytes(data)
    (folder / "empty.fasta").write_bytes(b"")
    (folder / "_SUCCESS").write_bytes(b">no\n")
    (folder / "sub" / "z.fasta.gz").write_bytes(gzip.compress(b">{400}G400~x\nAC\nGT"))
    rows = fmt.read.format("fasta").option("splitBytes", 1000).load(str(folder))
    assert rows.rdd.getNumPartitions() == -(-len(data) // 1000) + 1
    got = sorted((r["file"], r["ord"], r["header"], r["seq"]) for r in rows.collect())
    assert [g[1:] for g in got[:399]] == plain(data) and got[399][2:] == ("{400}G400~x", "ACGT") and len(got) == 400
    heads = fmt.read.format("fasta").option("headersOnly", True).option("splitBytes", 1000).load(str(folder))
    assert heads.columns == ["file", "ord", "header"]
    assert sorted(r["idx"] for r in fasta.consecutive(heads, folder=True).collect()) == list(range(1, 401))
    assert fmt.read.format("fasta").load(str(folder / "empty.fasta")).count() == 0
    with pytest.raises(Exception, match="FileNotFound|nothing"):
        fmt.read.format("fasta").load(str(tmp_path / "nothing")).count()


@pytest.mark.parametrize("width", [0, 3])
def test_write_and_read_again(fmt, tmp_path, width):
    rows = [("h1 d__a", "ACGTACG", 1), ("", "", 2), ("h3", None, 3), (None, "AC", 4)]
    df = fmt.createDataFrame(rows, "header string, seq string, file long").repartition(3)
    path = str(tmp_path / "out")
    df.write.format("fasta").mode("append").option("lineWidth", width).save(path)
    df.write.format("fasta").mode("append").option("lineWidth", width).save(path)
    back = fmt.read.format("fasta").load(path)
    want = sorted((h or "", s or "") for h, s, _ in rows)
    assert sorted((r["header"], r["seq"]) for r in back.collect()) == sorted(want * 2)
    df.where("file = 1").write.format("fasta").mode("overwrite").save(path)
    assert [(r["header"], r["seq"]) for r in fmt.read.format("fasta").load(path).collect()] == [("h1 d__a", "ACGTACG")]
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")] == []


def test_failed_write_leaves_what_was_there(fmt, tmp_path):
    path = str(tmp_path / "out")
    fmt.createDataFrame([("a", "A")], "header string, seq string").write.format("fasta").mode("append").save(path)
    bad = fmt.createDataFrame([("b", "A"), ("c\nd", "A")], "header string, seq string")
    with pytest.raises(Exception, match="several lines"):
        bad.write.format("fasta").mode("overwrite").save(path)
    assert [r["header"] for r in fmt.read.format("fasta").load(path).collect()] == ["a"] and len(list((tmp_path / "out").iterdir())) == 1
