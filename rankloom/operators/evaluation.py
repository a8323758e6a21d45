"""Classification and clustering scores over prediction tables. Long tables (one row for each item, rank and method) come from unpivot; scores are aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.shared import written
from . import ordering
from .neighbours import matrix


def valid(pred: Column, in_train: Column, missing_counts: bool = True) -> Column:
    """Whether a prediction counts: its true taxon is in the training set and it isn't empty. missing_counts: a row that a join didn't find counts as wrong, an empty cell doesn't."""
    return in_train & (F.coalesce(pred, F.lit("<missing>")) != "") if missing_counts else in_train & pred.isNotNull() & (pred != "")


def accuracy(rows: DataFrame, by: list[str], true: str = "true", pred: str = "pred") -> DataFrame:
    """(by, n_valid, accuracy): a missing prediction is wrong."""
    ok = F.coalesce(F.col(true) == F.col(pred), F.lit(False)).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n_valid"), F.round(F.avg(ok), 6).alias("accuracy"))


def macro_accuracy(rows: DataFrame, by: list[str], true: str = "true", pred: str = "pred") -> DataFrame:
    each = rows.groupBy(*by, true).agg(F.avg(F.coalesce(F.col(true) == F.col(pred), F.lit(False)).cast("double")).alias("a"))
    return each.groupBy(*by).agg(F.count("*").alias("n_taxa"), F.round(F.avg("a"), 6).alias("macro_accuracy"))


def deepest_correct(trues: Column, preds: Column, known: Column | None = None) -> Column:
    """Number of leading ranks that are right; stops at the first that is wrong, empty or null, or whose true taxon isn't among the training rows (``known``, one boolean a rank)."""
    if known is not None:
        trues = F.zip_with(trues, known, lambda t, k: F.when(k, t))
    both = F.zip_with(trues, preds, lambda t, p: F.coalesce((t == p) & (t != ""), F.lit(False)))
    return F.aggregate(both, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, ok: F.struct((s["n"] + F.when(s["on"] & ok, 1).otherwise(0)).alias("n"), (s["on"] & ok).alias("on")), lambda s: s["n"])


def known_taxa(rows: DataFrame, train: DataFrame, ranks: list[str]) -> DataFrame:
    """rows with known: for each rank whether its true taxon has a training row. Taxa are one row each before they meet the rows."""
    flags = []
    for r in ranks:
        seen = train.where(F.col(r).isNotNull()).select(F.col(r).alias(f"__{r}")).distinct().withColumn(f"__k_{r}", F.lit(True))
        rows = rows.join(seen, F.col(r) == F.col(f"__{r}"), "left").drop(f"__{r}")
        flags.append(F.coalesce(f"__k_{r}", F.lit(False)))
    return rows.withColumn("known", F.array(*flags)).drop(*[f"__k_{r}" for r in ranks])


def depth_counts(rows: DataFrame, depth: str, names: list[str], by: list[str]) -> DataFrame:
    """(by, depth, deepest, n_rows, share): how many rows are right down to each rank, 'None' for depth 0; ranks that no row reaches are there with 0."""
    counts = rows.groupBy(*by, F.col(depth).cast("long").alias("depth")).agg(F.count("*").alias("n_rows"))
    total = counts.groupBy(*by).agg(F.sum("n_rows").alias("__all"))
    each = total.select(*by, "__all", F.posexplode(F.array(*[F.lit(n) for n in ["None", *names]])).alias("depth", "deepest")).withColumn("depth", F.col("depth").cast("long"))
    n = F.coalesce("n_rows", F.lit(0))
    return each.join(counts, [*by, "depth"], "left").select(*by, "depth", "deepest", n.alias("n_rows"), F.round(n / F.col("__all"), 6).alias("share"))


def confidence_spread(rows: DataFrame, by: list[str], conf: str) -> DataFrame:
    stats = [F.count("*").alias("n_rows"), F.min(conf).alias("least"), F.max(conf).alias("most")]
    return ordering.with_quantiles(rows.select(*by, conf), by, conf, {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}, stats)


def calibration_width(rows: DataFrame, by: list[str], conf: str, correct: str, bins: int = 10, least: int = 10) -> DataFrame:
    """Equal-width bins of [0, 1], the last one closed; bins of few rows go."""
    b = F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n_rows"), F.round(F.avg(conf), 6).alias("mean_conf"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy")).where(F.col("n_rows") >= least)


def calibration_count(rows: DataFrame, by: list[str], conf: str, correct: str, key: str, chunks: int = 100) -> DataFrame:
    """Chunks of equal counts in order of confidence; a group with fewer rows than chunks is one chunk.

    The chunk of a row follows from its place among all rows of its group, which is counted over partitions of their order.
    """
    at = ordering.numbered(rows.select(*by, conf, correct, key), by, [conf, key], "__r", "__n")
    big, size = F.col("__n") % chunks, F.floor(F.col("__n") / chunks)
    cut = big * (size + 1)
    chunk = F.when(F.col("__n") < chunks, 1).when(F.col("__r") < cut, F.floor(F.col("__r") / (size + 1)) + 1).otherwise(big + F.floor((F.col("__r") - cut) / F.greatest(size, F.lit(1))) + 1)
    return at.groupBy(*by, chunk.cast("long").alias("chunk")).agg(
        F.count("*").alias("n_rows"), F.min(conf).alias("low"), F.max(conf).alias("high"), F.round(F.avg(conf), 6).alias("mean_conf"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy")
    )


def correlations(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n_rows, pearson, spearman) of groups of three rows or more; nulls in either don't count.

    Rows are counted by (group, x, y) first; average ranks come from counted values and join these counts, so a value that very many rows have is one line.
    """
    joint = written(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c")), "joint")

    def ranked(col: str) -> DataFrame:
        counts = joint.groupBy(*by, col).agg(F.sum("c").alias("c"))
        got = ordering.cumulated(counts, by, [col], "c", "__before", "__all")
        return got.select(*[F.col(c).alias(f"__{col}_{c}") for c in by], F.col(col).alias(f"__of_{col}"), ((F.col("__before") + (F.col("c") + 1) / 2) / F.col("__all")).alias(f"r{col}"))

    for col in ("x", "y"):
        right = ranked(col)
        on = F.col(col) == F.col(f"__of_{col}")
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"__{col}_{c}"))
        joint = joint.join(right, on).drop(f"__of_{col}", *[f"__{col}_{c}" for c in by])
    d = lambda c: F.col(c).cast("double")
    means = joint.groupBy(*by).agg(*[(F.sum(d(v) * d("c")) / F.sum(d("c"))).alias(f"m{v}") for v in ("x", "y", "rx", "ry")])
    here = F.lit(True)
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"__m_{c}"))
    held = joint.join(F.broadcast(means.select(*[F.col(c).alias(f"__m_{c}") for c in by], "mx", "my", "mrx", "mry")) if by else means, here).drop(*[f"__m_{c}" for c in by])
    part = lambda a, b: F.sum(d("c") * (d(a) - F.col(f"m{a}")) * (d(b) - F.col(f"m{b}")))
    r = lambda a, b: F.round(part(a, b) / F.nullif(F.sqrt(part(a, a) * part(b, b)), F.lit(0.0)), 6)
    return held.groupBy(*by).agg(F.sum("c").alias("n_rows"), r("x", "y").alias("pearson"), r("rx", "ry").alias("spearman")).where("n_rows >= 3")


def confusions(rows: DataFrame, n: int, true: str = "true", pred: str = "pred") -> DataFrame:
    """The n most frequent wrong pairs and their share of all errors."""
    wrong = rows.where(F.col(true) != F.col(pred))
    pairs = wrong.groupBy(true, pred).agg(F.count("*").alias("n_rows"))
    whole = pairs.agg(F.sum("n_rows").alias("all"))
    return pairs.orderBy(F.desc("n_rows"), true, pred).limit(n).join(F.broadcast(whole)).select(true, pred, "n_rows", F.round(F.col("n_rows") / F.col("all"), 6).alias("share"))


def taxon_scores(rows: DataFrame, by: list[str], true: str = "true", pred: str = "pred") -> DataFrame:
    """(by, taxon, n_true, n_pred, recall, precision, f1); rows without a prediction lower recall alone."""
    right = F.sum(F.coalesce(F.col(true) == F.col(pred), F.lit(False)).cast("long"))
    t = rows.groupBy(*by, F.col(true).alias("taxon")).agg(F.count("*").alias("n_true"), right.alias("hit"))
    p = rows.where(F.col(pred).isNotNull() & (F.col(pred) != "")).groupBy(*by, F.col(pred).alias("taxon")).agg(F.count("*").alias("n_pred"))
    recall, precision = F.col("hit") / F.col("n_true"), F.col("hit") / F.col("n_pred")
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision))
    return t.join(p, [*by, "taxon"], "left").select(*by, "taxon", "n_true", F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(f1, 6).alias("f1"))


def scores_by_train_size(rows: DataFrame, train: DataFrame, by: list[str], label: str, true: str = "true", pred: str = "pred") -> DataFrame:
    """taxon_scores with n_train, over the rows alone whose true taxon the training rows have: what is predicted for others doesn't lower a precision."""
    sizes = train.where(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(F.col(label).alias("__t")).agg(F.count("*").alias("n_train"))
    known = rows.join(sizes, F.col(true) == F.col("__t"), "left_semi")
    return taxon_scores(known, by, true, pred).join(sizes, F.col("taxon") == F.col("__t")).drop("__t")


def absent(rows: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """(label, n_rows): labels that the training rows lack."""
    return rows.groupBy(label).agg(F.count("*").alias("n_rows")).join(train.select(label).distinct(), label, "left_anti")


def absent_by_rank(rows: DataFrame, train: DataFrame, ranks: list[str]) -> DataFrame:
    """(rank, taxon, n_rows, share): at each rank the labels that the training rows lack, and their share of all rows."""
    told = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(r).cast("string").alias("taxon")) for r in ranks])).alias("x")).select("x.*").where("taxon IS NOT NULL AND taxon <> ''")
    n = rows.agg(F.count("*").alias("__n"))
    found = told(rows).groupBy("rank", "taxon").agg(F.count("*").alias("n_rows")).join(told(train).distinct(), ["rank", "taxon"], "left_anti")
    return found.join(F.broadcast(n)).select("rank", "taxon", "n_rows", F.round(F.col("n_rows") / F.col("__n"), 6).alias("share"))


# Clusterings


def contingency(rows: DataFrame, label: str, cluster: str) -> DataFrame:
    """(label, cluster, n, a, b, total): joint counts with both margins; all later scores read this small table."""
    n = rows.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    a = n.groupBy("label").agg(F.sum("n").alias("a"))
    b = n.groupBy("cluster").agg(F.sum("n").alias("b"))
    return n.join(a, "label").join(b, "cluster").join(F.broadcast(n.agg(F.sum("n").alias("total"))))


def agreement(rows: DataFrame, label: str, cluster: str) -> DataFrame:
    """One row: homogeneity, completeness, v_measure, adjusted_rand."""
    t = contingency(rows, label, cluster)
    x = lambda v: v.cast("double")
    n, a, b, m = (x(F.col(c)) for c in ("n", "a", "b", "total"))
    by_label = t.select("label", "a", "total").distinct().agg(F.sum(-a / m * F.log(a / m)).alias("hc"), F.sum(a * (a - 1) / 2).alias("pa"))
    by_cluster = t.select("cluster", "b", "total").distinct().agg(F.sum(-b / m * F.log(b / m)).alias("hk"), F.sum(b * (b - 1) / 2).alias("pb"))
    joint = t.agg(F.sum(-n / m * F.log(n / b)).alias("hck"), F.sum(-n / m * F.log(n / a)).alias("hkc"), F.sum(n * (n - 1) / 2).alias("pn"), F.max(m).alias("m"))
    one = joint.join(F.broadcast(by_label)).join(F.broadcast(by_cluster))
    h = F.when(F.col("hc") == 0, 1.0).otherwise(1 - F.col("hck") / F.col("hc"))
    c = F.when(F.col("hk") == 0, 1.0).otherwise(1 - F.col("hkc") / F.col("hk"))
    expected = F.col("pa") * F.col("pb") / (F.col("m") * (F.col("m") - 1) / 2)
    ari = (F.col("pn") - expected) / ((F.col("pa") + F.col("pb")) / 2 - expected)
    return one.select(F.round(h, 6).alias("homogeneity"), F.round(c, 6).alias("completeness"), F.round(F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)), 6).alias("v_measure"), F.round(ari, 6).alias("adjusted_rand"))


#: Numbers of common rows that are summed up at once.
STRIDE = 1 << 16


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """log n! to about 1e-15 of its size: summed up to 255, then Stirling's series."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])
    x = np.maximum(n, 1).astype(np.float64) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 256, small[np.minimum(n, 255)], series)


def expected_information(a: int, b: int, n: int) -> float:
    """Expected contribution of a label of a rows and a cluster of b rows, of n in all, to their information where clusters are drawn at random.

    The number k of common rows is hypergeometric. Its probability at the mode comes from log-gamma; from there on to
    both sides each is the last one times the ratio of neighbours, until none is left that counts. Memory is STRIDE numbers,
    whatever the number of rows; terms are as many as lie around the mode.
    """
    low, high = max(0, a + b - n), min(a, b)
    mode = min(high, max(low, (a + 1) * (b + 1) // (n + 2)))
    at = np.array([a, b, n - a, n - b, n, mode, a - mode, b - mode, n - a - b + mode])
    f = _log_factorial(at)
    peak = math.exp(f[0] + f[1] + f[2] + f[3] - f[4] - f[5] - f[6] - f[7] - f[8])
    term = lambda k: np.where(k > 0, k / n * (np.log(np.maximum(k, 1.0)) + math.log(n) - math.log(a) - math.log(b)), 0.0)
    total = float(peak * term(np.array([float(mode)]))[0])
    for step in (1, -1):
        last, k = peak, mode
        while last > peak * 1e-18 and (k < high if step > 0 else k > low):
            end = min(high, k + STRIDE) if step > 0 else max(low, k - STRIDE)
            here = np.arange(k, end, step, dtype=np.float64)  # ratios from each of these to the next
            ratio = (a - here) * (b - here) / ((here + 1) * (n - a - b + here + 1)) if step > 0 else here * (n - a - b + here) / ((a - here + 1) * (b - here + 1))
            p = last * np.cumprod(ratio)
            total += float((p * term(here + step)).sum())
            last, k = float(p[-1]), end
    return total


def adjusted_mutual_information(rows: DataFrame, label: str, cluster: str) -> DataFrame:
    """One row: ami. The expected information follows from the margins' sizes alone: equal sizes are grouped, and each pair of sizes is one sum."""
    t = contingency(rows, label, cluster)
    margins = t.select("label", "a", "total").distinct().groupBy("a", "total").agg(F.count("*").alias("na"))
    others = t.select("cluster", "b").distinct().groupBy("b").agg(F.count("*").alias("nb"))
    told = others.agg(F.collect_list(F.struct("b", "nb")).alias("others"))  # distinct sizes: at most the square root of twice the rows
    pairs = margins.join(F.broadcast(told)).select("a", "total", "na", F.explode("others").alias("o")).select("a", F.col("o.b").alias("b"), "total", (F.col("na") * F.col("o.nb")).alias("m"))

    @F.pandas_udf("double")
    def expected(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([expected_information(int(x), int(y), int(z)) for x, y, z in zip(a, b, n, strict=True)], dtype="float64")

    emi = pairs.repartition(F.col("a"), F.col("b")).agg(F.sum(F.col("m") * expected("a", "b", "total")).alias("emi"))
    n, a, b, m = (F.col(c).cast("double") for c in ("n", "a", "b", "total"))
    mi = t.agg(F.sum(n / m * F.log(n * m / (a * b))).alias("mi"))
    hc = t.select("label", "a", "total").distinct().agg(F.sum(-a / m * F.log(a / m)).alias("hc"))
    hk = t.select("cluster", "b", "total").distinct().agg(F.sum(-b / m * F.log(b / m)).alias("hk"))
    one = mi.join(F.broadcast(emi)).join(F.broadcast(hc)).join(F.broadcast(hk))
    return one.select(F.round((F.col("mi") - F.col("emi")) / ((F.col("hc") + F.col("hk")) / 2 - F.col("emi")), 6).alias("ami"))


def ordered_contingency(rows: DataFrame, label: str, cluster: str) -> DataFrame:
    """contingency with row_place and col_place: clusters by size (then id), labels by the place of their largest cluster, then size there (then name).

    Labels and clusters are few next to the rows; the orders are taken over their margins.
    """
    t = contingency(rows, label, cluster)
    cols = ordering.numbered(t.select("cluster", (-F.col("b")).alias("size")).distinct(), [], ["size", "cluster"], "col_place").drop("size")
    both = t.join(cols, "cluster")
    best = both.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), "col_place")).alias("m"))
    order = ordering.numbered(best.select("label", F.col("m.col_place").alias("first"), F.col("m.n").alias("size")), [], ["first", "size", "label"], "row_place").drop("first", "size")
    return both.join(order, "label").select("label", "cluster", "n", "row_place", "col_place")


def dominant_clusters(rows: DataFrame, label: str, cluster: str, least: bool = False) -> DataFrame:
    """(label, cluster, precision, recall, f1) of each label's largest cluster, the lowest id on ties. F1 divides by the sum plus 1e-9, or by at least 1e-9."""
    best = contingency(rows, label, cluster).groupBy("label").agg(F.max(F.struct("n", (-F.col("cluster")).alias("c"), "a", "b")).alias("m"))
    p, r = F.col("m.n") / F.col("m.b"), F.col("m.n") / F.col("m.a")
    return best.select("label", (-F.col("m.c")).alias("cluster"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (F.greatest(p + r, F.lit(1e-9)) if least else p + r + 1e-9), 6).alias("f1"))


def congruency(vectors: DataFrame, item: str, vector: str, side: str, eps: float = 1e-5) -> DataFrame:
    """(same, other, ssc): mean squared distance inside an item's vectors against that between two sets, by sums of vectors alone."""
    v = F.col(vector)
    dims = vectors.select(item, side, F.posexplode(v).alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    own = dims.groupBy(item, "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("s2"), F.count("*").alias("m"))
    inside = own.groupBy(item).agg(((F.max("m") * F.sum("s2") - F.sum(F.col("s") * F.col("s"))) / (F.max("m") * (F.max("m") - 1) / 2)).alias("w"), F.max("m").alias("m")).where("m > 1").agg(F.avg("w").alias("same"))
    sets = dims.groupBy(side, "at").agg(F.avg("x").alias("mu"), F.avg(F.col("x") * F.col("x")).alias("mu2"))
    a = sets.where(F.col(side) == 0).select("at", F.col("mu").alias("m0"), F.col("mu2").alias("q0"))
    b = sets.where(F.col(side) == 1).select("at", F.col("mu").alias("m1"), F.col("mu2").alias("q1"))
    other = a.join(b, "at").agg(F.sum(F.col("q0") + F.col("q1") - 2 * F.col("m0") * F.col("m1")).alias("other"))
    return inside.join(F.broadcast(other)).select(F.round("same", 6).alias("same"), F.round("other", 6).alias("other"), F.round((F.col("other") - F.col("same")) / (F.col("other") + eps), 6).alias("ssc"))


def run_scores(scores: DataFrame, by: list[str], run: str, score: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.countDistinct(run).alias("n_runs"), F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("std"))


def best_k(scores: DataFrame, by: list[str], k: str, mean: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.max(F.struct(F.col(mean), (-F.col(k)).alias("n"))).alias("b")).select(*by, (-F.col("b.n")).alias("best_k"), F.col(f"b.{mean}").alias("best_mean"))




def method_accuracy(rows: DataFrame, by: list[str], methods: tuple[str, str], true: str = "true") -> DataFrame:
    """(by, n_valid_x, accuracy_x of both methods, delta): the first method's accuracy less the second's. rows: true and pred_<method>; an empty prediction isn't valid, a missing one is wrong."""
    cols = []
    for m in methods:
        pred = F.col(f"pred_{m}")
        ok = F.coalesce(pred, F.lit("<missing>")) != ""
        cols += [F.count_if(ok).alias(f"n_valid_{m}"), F.avg(F.when(ok, F.coalesce(pred == F.col(true), F.lit(False)).cast("double"))).alias(f"__{m}")]
    got = rows.groupBy(*by).agg(*cols)
    a, b = methods
    return got.select(*by, f"n_valid_{a}", f"n_valid_{b}", F.round(f"__{a}", 6).alias(f"accuracy_{a}"), F.round(f"__{b}", 6).alias(f"accuracy_{b}"), (F.round(F.col(f"__{a}") - F.col(f"__{b}"), 6) + 0.0).alias("delta"))


def with_p_values(rows: DataFrame, r: str, n: str, name: str) -> DataFrame:
    """rows with the two-sided p-value of a correlation r over n rows, from Student's t with n - 2 degrees of freedom."""

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_t_tail(float(x), int(k)) for x, k in zip(r, n, strict=True)], dtype="float64")

    return rows.withColumn(name, F.round(p_value(F.col(r), F.col(n)), 6))


def _t_tail(r: float, n: int) -> float | None:
    """P(|t| is larger): the regularised incomplete beta I(1 - r^2; (n - 2) / 2, 1 / 2), by its continued fraction."""
    if n < 3 or r != r:
        return None
    x, a, b = max(0.0, 1 - r * r), (n - 2) / 2, 0.5
    if x == 0.0 or x == 1.0:
        return x
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    # Terms from the last to the first: d(2m) and d(2m + 1) of the fraction.
    value = 1.0
    for k in range(400, 0, -1):
        m = k // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + d / value
    out = front / value
    return 1 - out if flip else out


def misclassified(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """(rank, true, pred, n_rows, total_num_seqs) of rows whose true_<rank> and pred_<rank> differ, at the ranks to record, beside how many rows there are."""
    total = rows.agg(F.count("*").alias("total_num_seqs"))
    pairs = F.array(*[F.struct(F.lit(r).alias("rank"), F.col(f"true_{r}").alias("true"), F.col(f"pred_{r}").alias("pred")) for r in ranks])
    wrong = rows.select(F.explode(pairs).alias("x")).select("x.*").where(~F.col("true").eqNullSafe(F.col("pred")))
    return wrong.groupBy("rank", "true", "pred").agg(F.count("*").alias("n_rows")).join(F.broadcast(total))


def sampled_congruency(vectors: DataFrame, item: str, vector: str, side: str, n: int, replicates: int, seed: int = 24, eps: float = 1e-5) -> DataFrame:
    """(replicate, same, other, ssc): congruency of n items of each side, drawn anew by hash for each replicate; sums of vectors alone, no pairs."""
    items = vectors.select(item, side).distinct().select(item, side, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    items = items.withColumn("__h", S.hashed(F.col(item) * 1_009 + F.col("replicate"), seed))
    drawn = ordering.numbered(items, ["replicate", side], ["__h", item]).where(F.col("__place") < n).select("replicate", item)
    dims = vectors.select(item, side, F.posexplode(vector).alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    own = dims.groupBy(item, side, "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("s2"), F.count("*").alias("m"))
    whole = own.groupBy(item, side).agg(F.sum("s2").alias("q"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("m").alias("m"), F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda z: z["s"]).alias("sum"))
    held = drawn.join(whole, item)
    m = F.col("m")
    inside = held.where("m > 1").groupBy("replicate").agg(F.avg((m * F.col("q") - F.col("ss")) / (m * (m - 1) / 2)).alias("same"))
    sets = held.select("replicate", side, "q", "m", F.posexplode("sum").alias("at", "s")).groupBy("replicate", side, "at").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("m").alias("m"))
    a = sets.where(F.col(side) == 0).select("replicate", "at", (F.col("s") / F.col("m")).alias("m0"), (F.col("q") / F.col("m")).alias("q0"))
    b = sets.where(F.col(side) == 1).select("replicate", "at", (F.col("s") / F.col("m")).alias("m1"), (F.col("q") / F.col("m")).alias("q1"))
    other = a.join(b, ["replicate", "at"]).groupBy("replicate").agg((F.max("q0") + F.max("q1") - 2 * F.sum(F.col("m0") * F.col("m1"))).alias("other"))
    return inside.join(other, "replicate").select("replicate", F.round("same", 6).alias("same"), F.round("other", 6).alias("other"), F.round((F.col("other") - F.col("same")) / (F.col("other") + eps), 6).alias("ssc"))


DISTANCES = ("squared", "euclidean", "cosine")


def pair_congruency(vectors: DataFrame, item: str, vector: str, side: str, distance: str, n: int, runs: int, replicates: int, seed: int = 24, eps: float = 1e-5) -> DataFrame:
    """(run, replicate, same, other, ssc): like sampled_congruency, by the distances of pairs: squared, euclidean or cosine; with its runs and replicates.

    An item's own vectors, one for each region, are few and meet in one task. same: mean distance of all pairs inside an item, averaged over the items drawn; other: mean distance between the vectors of the
    items drawn of both sides. A replicate has at most 2 n items; its pairs are made block against block in tasks, one group for each
    replicate and block of one side, and come out as sums.
    """
    if distance not in DISTANCES:
        raise ValueError(f"distance must be one of {DISTANCES}")
    items = vectors.select(item, side).distinct()
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    items = items.select(item, side, upto(runs).alias("run")).select(item, side, "run", upto(replicates).alias("replicate"))
    items = items.withColumn("__h", S.hashed(F.col(item) * 1_009 + F.col("replicate") + F.col("run") * 100_003, seed))
    drawn = written(ordering.numbered(items, ["run", "replicate", side], ["__h", item]).where(F.col("__place") < n).select("run", "replicate", item), "drawn")
    v = vectors.select(item, F.col(side).alias("side"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    held = drawn.join(v, item).select("run", "replicate", F.col(item).cast("string").alias("item"), F.col("side").cast("int").alias("side"), "v")

    def inside(part: pa.Table) -> pa.Table:
        """The mean distance of an item's pairs."""
        x = matrix(part.column("v").combine_chunks())
        total = sum(float(_paired(x[k : k + 512], x[k:], distance)[np.triu_indices(len(x[k : k + 512]), 1, len(x) - k)].sum()) for k in range(0, len(x), 512))
        m = len(x)
        return pa.table({"run": [part.column("run")[0].as_py()], "replicate": [part.column("replicate")[0].as_py()], "w": [total / (m * (m - 1) / 2) if m > 1 else None]}, schema=pa.schema([("run", pa.int32()), ("replicate", pa.int32()), ("w", pa.float64())]))

    same = held.groupBy("run", "replicate", "item").applyInArrow(inside, "run int, replicate int, w double").groupBy("run", "replicate").agg(F.avg("w").alias("same"))

    # Blocks of one side meet the other side's blocks: as many copies of a vector as the other side has blocks.
    blocks = max(1, -(-n // 256))
    mine = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    spread = held.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.select("run", "replicate", "side", "v", F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("theirs")).alias("a"), F.when(F.col("side") == 0, F.col("theirs")).otherwise(F.col("mine")).alias("b"))

    def between(part: pa.Table) -> pa.Table:
        x, which = matrix(part.column("v").combine_chunks()), part.column("side").to_numpy()
        d = [_paired(x[which == 0][k : k + 512], x[which == 1], distance) for k in range(0, int((which == 0).sum()), 512)]
        return pa.table({"run": [part.column("run")[0].as_py()], "replicate": [part.column("replicate")[0].as_py()], "s": [float(sum(y.sum() for y in d))], "m": [int(sum(y.size for y in d))]}, schema=pa.schema([("run", pa.int32()), ("replicate", pa.int32()), ("s", pa.float64()), ("m", pa.int64())]))

    other = spread.groupBy("run", "replicate", "a", "b").applyInArrow(between, "run int, replicate int, s double, m long").groupBy("run", "replicate").agg((F.sum("s") / F.sum("m")).alias("other"))
    return same.join(other, ["run", "replicate"]).select("run", "replicate", F.round("same", 6).alias("same"), F.round("other", 6).alias("other"), F.round((F.col("other") - F.col("same")) / (F.col("other") + eps), 6).alias("ssc"))


def _paired(x: np.ndarray, y: np.ndarray, distance: str) -> np.ndarray:
    if distance == "cosine":
        length = lambda z: np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-8)
        return 1 - (x / length(x)) @ (y / length(y)).T
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0.0)
    return np.sqrt(d) if distance == "euclidean" else d
