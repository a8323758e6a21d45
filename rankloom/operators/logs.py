"""Training and mining logs: statistics overall, by rank and by bucket in one pass, and histories in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordering


POINTS = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def plain_stats(col: str) -> list[Column]:
    """Least, most, mean and sample standard deviation, rounded."""
    return [F.round(F.min(col), 6).alias("least"), F.round(F.max(col), 6).alias("most"), F.round(F.avg(col), 6).alias("mean"), F.round(F.stddev_samp(col), 6).alias("std")]


def box_stats(rows: DataFrame, sets: list[list[str]], values: dict[str, Column], by: list[str] | None = None, more: list[Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(by, columns of all sets, value, n_rows, statistics, more, quantiles): of each value once for each set of columns; 'All' stands for what a set doesn't group by.

    All sets and values are one table of counted values, so they share one ordering. ``more`` aggregates the columns of ``keep``.
    """
    long = ordering.long_form(rows, sets, values, [*(by or []), *(keep or [])])
    groups = [*(by or []), *dict.fromkeys(c for s in sets for c in s), "value"]
    return ordering.with_quantiles(long, groups, "x", POINTS, [F.count("*").alias("n_rows"), *plain_stats("x"), *(more or [])])


def five_numbers(least: str, low: str, middle: str, high: str, most: str) -> Column:
    """struct of a box plot's numbers, null if any of them is missing or no number."""
    names = dict(zip(("least", "p25", "median", "p75", "most"), (least, low, middle, high, most), strict=True))
    ok = F.lit(True)
    for c in names.values():
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return F.when(ok, F.struct(*[F.col(c).cast("double").alias(n) for n, c in names.items()]))


def loss_stats(rows: DataFrame, rank: str, bucket: str, loss: str) -> DataFrame:
    """(rank, bucket, n_rows, statistics): overall, by rank and by bucket; 'All' stands for what isn't grouped."""
    held = rows.select(F.col(rank).alias("rank"), F.col(bucket).alias("bucket"), F.col(loss).alias(loss))
    return box_stats(held, [[], ["rank"], ["bucket"]], {"loss": F.col(loss)}).drop("value")


def satisfaction(triplets: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, wrong, inside_margin, satisfied): shares of triplets by how the negative stands to the positive."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    ap, an, m = F.col("ap"), F.col("an"), F.col("margin")
    return triplets.groupBy(*by).agg(F.count("*").alias("n_rows"), share(ap >= an).alias("wrong"), share((ap < an) & (ap + m > an)).alias("inside_margin"), share(ap + m <= an).alias("satisfied"))


def region_matrix(pairs: DataFrame, region_a: str, region_b: str, err: str) -> DataFrame:
    """(low, high, n_rows, mean_err) for unordered pairs of regions."""
    return pairs.groupBy(F.least(region_a, region_b).alias("low"), F.greatest(region_a, region_b).alias("high")).agg(F.count("*").alias("n_rows"), F.round(F.avg(err), 6).alias("mean_err"))


def relative_changes(history: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """history with its change against the row before, over the size of that row."""
    held = ordering.beside_previous(history, by, [order], value, "__before")
    return held.withColumn("change", F.round((F.col(value) - F.col("__before")) / F.nullif(F.abs("__before"), F.lit(0.0)), 6)).drop("__before")


def filled_down(history: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """A value that wasn't measured stays as it last was."""
    return ordering.carried_on(history, by, [order], value)


def wide(history: DataFrame, index: str, name: str, value: str, names: list[str]) -> DataFrame:
    return history.groupBy(index).pivot(name, names).agg(F.round(F.avg(value), 6))


def size_score_correlation(rows: DataFrame, by: str, size: str, score: str) -> DataFrame:
    """(by, n_taxa, r): Pearson of log2(size) and score where there are more than two rows and both vary."""
    rows = rows.withColumn("__log", F.log2(size)).withColumn("__score", F.col(score).cast("double"))
    got = rows.groupBy(by).agg(F.count("*").alias("n_taxa"), S.correlation("__log", "__score").alias("r"), F.stddev_pop(size).alias("a"), F.stddev_pop(score).alias("b"))
    return got.where("n_taxa > 2 and a > 0 and b > 0").select(by, "n_taxa", F.round("r", 6).alias("r"))


def combination_shares(rows: DataFrame, a: str, b: str, ordered: bool = False) -> DataFrame:
    """(low, high, n_rows, share) of group combinations."""
    low, high = (F.col(a), F.col(b)) if ordered else (F.least(a, b), F.greatest(a, b))
    n = rows.groupBy(low.alias("low"), high.alias("high")).agg(F.count("*").alias("n_rows"))
    return n.join(F.broadcast(n.agg(F.sum("n_rows").alias("t")))).select("low", "high", "n_rows", F.round(F.col("n_rows") / F.col("t"), 6).alias("share"))


# Losses, pools and samples


def pair_loss_stats(pairs: DataFrame, rank: str, bucket: str, true: str = "true", pred: str = "pred", eps: float = 1e-3) -> DataFrame:
    """loss_stats of the absolute error, with the mean error relative to max(true, eps) and how many predictions are too large, too small and equal."""
    diff = F.col(pred) - F.col(true)
    held = pairs.select(F.col(rank).alias("rank"), F.col(bucket).alias("bucket"), F.abs(diff).alias("abs_err"), (F.abs(diff) / F.greatest(F.col(true), F.lit(eps))).alias("__rel"), F.signum(diff).alias("__sign"))
    more = [F.round(F.avg("__rel"), 6).alias("mean_rel"), F.count_if(F.col("__sign") > 0).alias("n_over"), F.count_if(F.col("__sign") < 0).alias("n_under"), F.count_if(F.col("__sign") == 0).alias("n_equal")]
    return box_stats(held, [[], ["rank"], ["bucket"]], {"abs_err": F.col("abs_err")}, more=more, keep=["__rel", "__sign"]).drop("value")


def region_rank_matrix(pairs: DataFrame, region_a: str, region_b: str, rank: str, err: str) -> DataFrame:
    """region_matrix for each rank, and over all of them as 'All'."""
    low, high = F.least(region_a, region_b).alias("low"), F.greatest(region_a, region_b).alias("high")
    held = pairs.select(low, high, F.explode(F.array(F.col(rank).cast("string"), F.lit("All"))).alias("rank"), F.col(err).alias("err"))
    return held.groupBy("low", "high", "rank").agg(F.count("*").alias("n_rows"), F.round(F.avg("err"), 6).alias("mean_err"))


def pool_and_sample(pool: DataFrame, sample: DataFrame, rank: str, bucket: str, values: list[str]) -> DataFrame:
    """(source, value, rank, bucket, n_rows, statistics): the pool that a batch was drawn from beside what was drawn, for each value, overall, by rank and by bucket."""
    held = lambda rows, source: rows.select(F.lit(source).alias("source"), F.col(rank).alias("rank"), F.col(bucket).alias("bucket"), *[F.col(v).cast("double").alias(f"__v{k}") for k, v in enumerate(values)])
    both = held(pool, "pool").unionByName(held(sample, "sample"))
    return box_stats(both, [[], ["rank"], ["bucket"]], {v: F.col(f"__v{k}") for k, v in enumerate(values)}, by=["source"])


def stage_stats(stages: dict[str, DataFrame], rank: str, values: list[str], ap: str = "ap", an: str = "an", margin: str = "margin") -> tuple[DataFrame, DataFrame]:
    """(statistics, satisfaction) of the triplets that each stage of mining leaves: (stage, rank, value, n_rows, statistics) and (stage, rank, n_rows, wrong, inside_margin, satisfied), overall and by rank."""
    both = None
    for name, rows in stages.items():
        got = rows.select(F.lit(name).alias("stage"), F.col(rank).alias("rank"), F.col(ap).alias("ap"), F.col(an).alias("an"), F.col(margin).alias("margin"), *[F.col(v).cast("double").alias(f"__v{k}") for k, v in enumerate(values)])
        both = got if both is None else both.unionByName(got)
    stats = box_stats(both, [[], ["rank"]], {v: F.col(f"__v{k}") for k, v in enumerate(values)}, by=["stage"])
    long = both.withColumn("rank", F.explode(F.array(F.lit("All"), F.col("rank").cast("string"))))
    return stats, satisfaction(long, ["stage", "rank"])


def stage_counts(stages: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """(by, one count for each stage): how many rows of each rank or bucket the stages of mining leave."""
    out = None
    for name, rows in stages.items():
        got = rows.select(*by, F.lit(name).alias("stage"))
        out = got if out is None else out.unionByName(got)
    return out.groupBy(*by).agg(*[F.count_if(F.col("stage") == n).alias(f"n_{n}") for n in stages])


def rank_drops(before: DataFrame, after: DataFrame, rank: str = "rank") -> DataFrame:
    """(rank, n_before, n_after, n_dropped, share): pairs of each rank before and after subsampling; ignored ones (rank < -1) are what was dropped."""
    n = lambda df, name: df.where(F.col(rank) >= -1).groupBy(F.col(rank).alias("rank")).agg(F.count("*").alias(name))
    both = n(before, "n_before").join(n(after, "n_after"), "rank", "left").na.fill(0)  # one row for each rank
    return both.select("rank", "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_dropped"), F.round((F.col("n_before") - F.col("n_after")) / F.col("n_before"), 6).alias("share"))


def domain_counts(rows: DataFrame, batch: str, domain: str, names: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(batch, one count for each domain, the batch's constants): a line of the log for each batch."""
    got = rows.groupBy(batch).agg(*[F.count_if(F.col(domain) == n).alias(n) for n in names])
    return got.select("*", *[F.lit(v).alias(k) for k, v in (weights or {}).items()])


def loss_history(rows: DataFrame, batch: str, rank: str, loss: str, ranks: list[str], s: float = 0.0) -> DataFrame:
    """(batch, total, weighted, one mean for each rank): the mean loss, weighted by its uncertainty s, and its means by rank."""
    each = rows.groupBy(batch, rank).agg(F.sum(loss).alias("__s"), F.count("*").alias("__n"))
    mean = F.sum("__s") / F.sum("__n")
    by = [F.round(F.max(F.when(F.col(rank) == r, F.col("__s") / F.col("__n"))), 6).alias(r) for r in ranks]
    return each.groupBy(batch).agg(F.round(mean, 6).alias("total"), F.round(S.uncertainty_weighted(mean, F.lit(s)), 6).alias("weighted"), *by)


def last_snapshot(history: DataFrame, by: list[str], order: str) -> DataFrame:
    """The newest row of each group, and how many rows it has."""
    rest = [c for c in history.columns if c not in by]
    got = history.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x"), F.count("*").alias("n_logged"))
    return got.select(*by, "n_logged", *[F.col(f"x.{c}").alias(c) for c in rest])


def metrics_like(history: DataFrame, name: str, pattern: str) -> DataFrame:
    """Rows whose metric matches a pattern with one *, with what the * stands for as ``captured``."""
    head, _, tail = pattern.partition("*")
    quoted = lambda t: "".join("\\" + c if not c.isalnum() else c for c in t)
    regexp = f"^{quoted(head)}(.*){quoted(tail)}$" if "*" in pattern else f"^{quoted(head)}()$"
    return history.where(F.col(name).rlike(regexp)).withColumn("captured", F.regexp_extract(name, regexp, 1))


def due(batch: Column, every: int) -> Column:
    """Whether a batch is logged: the first one and every so many."""
    return (batch == 1) | (batch % every == 0)


def introduced(rank: Column, batch: Column, starts: dict[str, int]) -> Column:
    """Whether a rank takes part at a batch; ranks that ``starts`` doesn't name do from the beginning."""
    first = F.lit(0)
    for name, at in starts.items():
        first = F.when(rank == name, at).otherwise(first)
    return batch >= first
