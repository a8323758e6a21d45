"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed with each dictionary. The difference of the two sizes, divided by
the text's length to the power POWER (which is what makes short and long texts
comparable), is the only thing that a score depends on; a logistic fit turns it into
the probability of label 1.

Both dictionaries have the same size: what training leaves unfilled is filled with
segments of the same texts, or a text that neither dictionary knows would seem nearer
to the larger one. The models are fitted on the driver from at most SAMPLE labelled
rows of each label outside the held-out fold, those with the smallest id hash and at
most LONGEST bytes: one half fills the dictionaries, the other calibrates, each label
weighing as much as it does among all labelled rows outside the fold. Everything else
streams by in Arrow batches, whole texts of any length.

Defined cases: null and empty texts get the labelled rows' share of label 1; rows
without a label or with a null id are scored, not learned from; an id that is labelled
both ways isn't learned from; of an id's several texts the smallest is; repeated rows
are scored alike; without labels of both kinds every score is that share (0.5 without
any); an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among_least, held_out, kept

#: Labelled rows of each label that a model may be fitted on, and the most bytes of such a text.
SAMPLE, LONGEST = 4000, 16_384
#: Bytes of a dictionary, of a training segment, of a filling segment, and the compression level.
DICTIONARY, SEGMENT, FILLING, LEVEL = 524_288, 2048, 256, 3
#: Length normalisation of the difference, and texts whose scores one batch holds.
POWER, ROWS = 0.75, 1000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> tuple[list[tuple[str, int]], float | None]:
    """At most ``sample`` (text, label) pairs of each label outside the held-out fold, of at most ``longest`` bytes each,
    and the share of label 1 among all labelled ids outside it. The chosen ids are few enough to broadcast; texts aren't shuffled."""
    y = F.col(label).try_cast("int")
    named = labels.select(F.col("doc_id").try_cast("long").alias("__l"), y.alias("__y")).where(F.col("__l").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__l")))
    each = named.groupBy("__l").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z").select("__l", "__y")
    share = each.agg(F.avg("__y")).first()[0]
    chosen = None
    for k in (0, 1):
        some = among_least(each.where(F.col("__y") == k), "__l", sample).orderBy(F.xxhash64("__l"), "__l").limit(sample)
        chosen = some if chosen is None else chosen.union(some)
    rows = docs.select(F.col(id_col).try_cast("long").alias("__id"), F.col(text_col).cast("string").alias("__t")).where(F.octet_length("__t") <= longest)
    got = rows.join(F.broadcast(chosen), F.col("__id") == F.col("__l")).groupBy("__id", "__y").agg(F.min("__t").alias("__t")).collect()  # 2 * sample rows at most
    return [(r["__t"], r["__y"]) for r in sorted(got, key=lambda r: r["__id"])], share


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-6, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; x has a column of ones."""
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge * len(x) + 1e-9) * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * len(x) * w)
    return w


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray | None
    share: float


class _Sizes:
    def __init__(self, good: bytes, bad: bytes):
        def tool(d: bytes):
            held = zstandard.ZstdCompressionDict(d)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = tool(good), tool(bad)

    def differences(self, texts: list[str]) -> np.ndarray:
        """How much larger each text gets with the dictionary of bad texts, normalised."""
        raw = [t.encode() for t in texts]
        return np.array([(len(self.bad.compress(r)) - len(self.good.compress(r))) / max(1, len(r)) ** POWER for r in raw])


def _dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """The trained dictionary, with segments of the texts before it where it is smaller than wanted."""
    raw = [t.encode() for t in texts]
    try:
        got = zstandard.train_dictionary(size, [r[k : k + SEGMENT] for r in raw for k in range(0, len(r), SEGMENT)], k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        got = b""  # too little text to choose from
    if len(got) > size - FILLING:
        return got
    cut = [r[k : k + FILLING] for r in raw for k in range(0, len(r), FILLING)]
    random.Random(1).shuffle(cut)
    filling = b"".join(cut)[: size - len(got)]
    return filling + got if len(filling) + len(got) >= 8 else b" " * 8


def fit(pairs: list[tuple[str, int]], share: float | None = None) -> Model:
    """share: of label 1 where the score is used; that of the pairs unless it is given."""
    share = share if share is not None else float(np.mean([v for _, v in pairs])) if pairs else 0.5
    good, bad = [t for t, v in pairs if v == 1 and t], [t for t, v in pairs if v == 0 and t]
    if len(good) < 2 or len(bad) < 2:
        return Model(b"", b"", None, share)
    model = Model(_dictionary(good[::2]), _dictionary(bad[::2]), None, share)
    least = min(len(model.good), len(model.bad))
    model.good, model.bad = model.good[-least:] if len(model.good) > least + FILLING else model.good, model.bad[-least:] if len(model.bad) > least + FILLING else model.bad
    x = _Sizes(model.good, model.bad).differences(good[1::2] + bad[1::2])
    n, m = len(good[1::2]), len(bad[1::2])
    y = np.r_[np.ones(n), np.zeros(m)]
    prior = min(max(share, 1e-3), 1 - 1e-3)
    w = logistic(np.stack([np.ones(len(x)), x / (x.std() + 1e-9)], 1), y, np.r_[np.full(n, prior / n), np.full(m, (1 - prior) / m)] * len(y))
    model.weights = np.array([w[0], max(w[1], 0.0) / (x.std() + 1e-9)])
    return model


def scores(model: Model, sizes: _Sizes | None, texts: list[str]) -> np.ndarray:
    out = np.full(len(texts), model.share)
    full = [k for k, t in enumerate(texts) if t]
    if sizes is not None and full:
        x = sizes.differences([texts[k] for k in full])
        out[full] = 1 / (1 + np.exp(-np.clip(model.weights[0] + model.weights[1] * x, -30, 30)))
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, score and the columns to keep, a row for each row of docs. A kept column that is the text isn't sent twice."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes at most
    sent = list(dict.fromkeys([id_col, text_col, *keep]))
    out = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = told.value
        sizes = kept(("quality", held.good, held.bad), lambda: _Sizes(held.good, held.bad)) if held.weights is not None else None
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            got = scores(held, sizes, [str(t.as_py() or "") for t in batch.column(1)])
            yield pa.record_batch([*[batch.column(sent.index(c)) for c in out], pa.array(got)], names=[*[f"c{k}" for k in range(len(out))], "score"])

    rows = docs.select(*[F.col(c).alias(f"s{k}") for k, c in enumerate(sent)])
    schema = ", ".join([*[f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(out)], "score double"])
    return rows.mapInArrow(run, schema).toDF(*[f"c{k}" for k in range(len(out))], "score").select(F.col("c0").alias(id_col), "score", *[F.col(f"c{k + 1}").alias(c) for k, c in enumerate(keep)])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    """One row per row: id_col, held_out, score, predicted."""
    model = fit(*labelled_sample(docs, labels, "quality", sample, id_col, text_col))
    return score(docs, model, id_col, text_col).select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
