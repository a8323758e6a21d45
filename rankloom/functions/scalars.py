"""Column expressions on headers, taxonomy paths, sequences, vectors, distances and losses. Each is a Spark expression; nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranks from the top, and the prefixes of their labels.
RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")
PREFIXES = ("d__", "p__", "c__", "o__", "f__", "g__", "s__")


def hashed(key: Column, seed: int = 0) -> Column:
    """A reproducible pseudo-random integer in [0, 2^31) for each key, the same in every engine."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(2147483648)) * 1103515245 + 12345 + seed, F.lit(2147483648))


def uniform(key: Column, seed: int = 0) -> Column:
    """A reproducible number in (0, 1) for each key."""
    return (hashed(key, seed) + 0.5) / 2147483648.0


def correlation(x: str, y: str) -> Column:
    """Pearson's r, null where either doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


# Headers and taxonomy


def genome_id(header: Column) -> Column:
    """Before ~ in the first word, without > and the {index}."""
    return F.regexp_extract(header, r"^>?(?:\{[^}]*\})?([^~ ]+)", 1)


def header_index(header: Column) -> Column:
    """The integer in {}, null where there is none."""
    return F.regexp_extract(header, r"\{(\d+)", 1).try_cast("long")


def header_region(header: Column) -> Column:
    return F.regexp_extract(header, r"\{\d+_([^}]*)\}", 1)


def taxonomy_path(header: Column) -> Column:
    """The ranks between the first space and the first bracket, prefixes removed."""
    told = F.trim(F.regexp_extract(header, r"^\S+ ([^\[]*)", 1))
    return F.transform(F.split(told, ";"), lambda t: F.regexp_replace(F.trim(t), "^[dpcofgs]__", ""))


def padded_path(path: Column, ranks: int = len(RANKS)) -> Column:
    """Exactly ``ranks`` labels, missing ones empty."""
    return F.slice(F.concat(F.coalesce(path, F.array().cast("array<string>")), F.array_repeat(F.lit(""), ranks)), 1, ranks)


def rank_label(path: Column, rank: int, unknown: str = "__unknown__") -> Column:
    return F.coalesce(F.nullif(F.trim(F.get(path, F.lit(rank))), F.lit("")), F.lit(unknown))


def shared_rank(a: Column, b: Column, ranks: int) -> Column:
    """Deepest rank up to which two paths agree from the top; -1 where they differ at once."""
    out = F.lit(-1)
    for r in range(ranks):
        same = F.lit(True)
        for k in range(r + 1):
            same = same & (F.get(a, F.lit(k)) == F.get(b, F.lit(k)))
        out = F.when(same, r).otherwise(out)
    return out


# Sequences


def base_codes(seq: Column) -> Column:
    """A, C, G, T as 0..3, anything else as 4."""
    return F.transform(F.filter(F.split(F.upper(seq), ""), lambda c: c != ""), lambda c: F.when(F.instr(F.lit("ACGT"), c) > 0, F.instr(F.lit("ACGT"), c) - 1).otherwise(4).cast("int"))


def fitted(codes: Column, length: int) -> Column:
    """Cropped or padded with 4 on the right."""
    return F.slice(F.concat(codes, F.array_repeat(F.lit(4), length)), 1, length)


def trimmed(seq: Column, bases: int) -> Column:
    """Without ``bases`` on either end; empty where there is no more."""
    return F.when(F.length(seq) <= 2 * bases, "").otherwise(F.substring(seq, F.lit(bases + 1), F.length(seq) - 2 * bases))


def kmer_index(kmer: Column) -> Column:
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def disambiguated(seq: Column, key: Column) -> Column:
    """IUPAC codes replaced by one of their bases, chosen by hash; unknown letters by N."""
    means = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}
    options = F.create_map(*[F.lit(x) for kv in (means | {c: c for c in "ACGTN"}).items() for x in kv])

    def one(c: Column, k: Column) -> Column:
        held = F.coalesce(F.try_element_at(options, c), F.lit("N"))
        return F.substring(held, (hashed(key * 8191 + k) % F.length(held)).cast("int") + 1, F.lit(1))

    return F.array_join(F.transform(F.filter(F.split(F.upper(seq), ""), lambda c: c != ""), one), "")


def mutated(codes: Column, key: Column, rate: float, seed: int = 0) -> Column:
    """Each base becomes one of the other three with the given rate."""
    return F.transform(codes, lambda c, k: F.when((c < 4) & (uniform(key * 8191 + k, seed) < rate), c.bitwiseXOR((1 + hashed(key * 8191 + k, seed + 1) % 3).cast("int"))).otherwise(c))


def truncated(seq: Column, key: Column, most_start: int, most_end: int, seed: int = 0) -> Column:
    """Random numbers of bases, both bounds included, go from the ends; at least one stays."""
    start = (hashed(key, seed) % (most_start + 1)).cast("int")
    end = (hashed(key, seed + 1) % (most_end + 1)).cast("int")
    first = F.least(start, F.length(seq) - 1)
    return F.substring(seq, first + 1, F.greatest(F.lit(1), F.length(seq) - first - end))


def clamped(seq: Column, length: int, start_slack: Column | None = None) -> Column:
    """At most ``length`` bases: up to ``start_slack`` go from the front first, the rest from the end."""
    over = F.greatest(F.lit(0), F.length(seq) - length)
    first = F.least(over, start_slack.cast("int")) if start_slack is not None else F.lit(0)
    return F.substring(seq, first + 1, F.lit(length))


def slack_shift(seq: Column, key: Column, length: int, seed: int = 0) -> Column:
    """A random start from 0 to what is left of ``length`` behind the sequence."""
    return hashed(key, seed) % (length + 1 - F.length(seq))


def shifted(seq: Column, shift: Column, length: int, pad: str = "-") -> Column:
    """The sequence ``shift`` places in, padded on both sides to ``length``."""
    return F.rpad(F.concat(F.repeat(F.lit(pad), shift.cast("int")), seq), length, pad)


# Vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column, least: float = 1e-8, how: str = "clip") -> Column:
    """L2 norm 1: clip the norm from below, add to it, or keep vectors of norm under ``least`` as they are."""
    norm = F.sqrt(dot(v, v))
    by = F.greatest(norm, F.lit(least)) if how == "clip" else norm + least if how == "add" else F.when(norm < least, 1.0).otherwise(norm)
    return F.transform(v, lambda x: x.cast("double") / by)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


# Distances, weights, losses


def adjusted_distance(d: Column, same_domain: Column, factor: Column, across: float = 1.6, gamma: float = 0.6) -> Column:
    """Domain factor inside a domain, a constant across, then gamma * d^log2(2 / gamma)."""
    scaled = F.when(same_domain, d * factor).otherwise(across)
    return F.lit(gamma) * F.pow(scaled, F.log2(F.lit(2 / gamma)))


def relative_error(pred: Column, true: Column, eps: float | Column = 1e-3) -> Column:
    return (pred - true) * (pred - true) / (true + eps)


def sign_bias(pred: Column, true: Column, beta: float) -> Column:
    return F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), beta * F.signum(pred - true))))


def representative_weight(count_i: Column, count_j: Column, baseline: Column, lam: float, low: float = 0.0, high: float = 1e9, eps: float = 1e-9) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.pow(baseline * baseline / (count_i * count_j + eps), lam)))


def keep_probability(count_i: Column, count_j: Column, baseline: Column, alpha: float, floor: float, warm: float | Column = 0.0) -> Column:
    """min(1, (b / sqrt(ci cj))^alpha), not under the floor, blended with 1 while warming up."""
    p = F.greatest(F.lit(floor), F.least(F.lit(1.0), F.pow(baseline / F.sqrt(count_i * count_j), alpha)))
    return warm + (1 - warm) * p


def gumbel_key(weight: Column, u: Column) -> Column:
    """The largest keys are a weighted draw without replacement."""
    return F.log(weight) - F.log(-F.log(u))


def warm_up(batch: Column, uniform_until: int, done_at: int) -> Column:
    """1 until uniform_until, linear to 0 at done_at, 0 after."""
    return F.when(batch <= uniform_until, 1.0).when(batch >= done_at, 0.0).otherwise(1.0 - (batch - uniform_until) / float(done_at - uniform_until))


def learning_rate(batch: Column, base: float, warm: int) -> Column:
    return F.when(batch < warm, base * (batch + 1) / float(warm)).otherwise(base)


def size_vote(n: Column, how: str = "sqrt") -> Column:
    return 1.0 / (n if how == "linear" else F.sqrt(n) if how == "sqrt" else F.log(n + 1.0))


def distance_vote(d: Column) -> Column:
    return 1.0 / (d * d + 1e-6)


def confidence(value: Column, percent: bool) -> Column:
    """A number in 0..1, null where the text is none."""
    return value.try_cast("double") / (100.0 if percent else 1.0)


def margin(true_ap: Column, true_an: Column, eps: float = 1.0) -> Column:
    return (true_an - true_ap) * eps


def normalised_violation(ap: Column, an: Column, m: Column, true_ap: Column, true_an: Column) -> Column:
    """The violation over the true distance between negative and positive."""
    return (ap - an + m) / (true_an - true_ap)


def signed_error(pred: Column, true: Column, eps: float | Column = 1e-3) -> Column:
    """The relative error with the sign of the difference."""
    return F.signum(pred - true) * relative_error(pred, true, eps)


def required_genome_id(header: Column) -> Column:
    """Between } and ~; a header without them is an error."""
    got = F.regexp_extract(header, r"\}([^~ ]+)~", 1)
    return F.when(got == "", F.raise_error(F.concat(F.lit("no genome id: "), header))).otherwise(got)


def rank_name(rank: Column) -> Column:
    """domain .. species for 0 .. 6, else rank_n."""
    names = F.array(*[F.lit(r) for r in RANKS])
    return F.coalesce(F.get(names, F.when(rank >= 0, rank.cast("int"))), F.concat(F.lit("rank_"), rank.cast("string")))


def qualified(label: Column, rank: int) -> Column:
    """A label with its rank's prefix, which makes it a key of its own rank."""
    return F.concat(F.lit(PREFIXES[rank]), label)


def joined(values: Column, digits: int = 4) -> Column:
    """Numbers with a stated number of digits, |-joined; a missing one is a dash, one too small to show is <."""
    least = 10.0**-digits
    one = lambda x: F.when(x.isNull(), "-").when((x != 0) & (F.abs(x) < least), "<").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))
    return F.array_join(F.transform(values, one), "|")


def lent(borrowed: Column) -> Column:
    """A map of bucket -> rows as bucket:rows, in order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(borrowed)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")


def triplet_loss(ap: Column, an: Column, m: Column, scale: float = 1.0, cap: float = 4.0) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(0.0), ap - an + m) * scale)


def pair_loss(pred: Column, true: Column, eps: float = 1e-3, cap: float = 2.0) -> Column:
    return F.least(F.lit(cap), relative_error(pred, true, eps))


def uncertainty_weighted(loss: Column, s: Column) -> Column:
    return 0.5 * F.exp(-s) * loss + 0.5 * s


def region_label(region: Column) -> Column:
    return F.when(region == 0, "Full").otherwise(F.concat(F.lit("R"), region.cast("string")))


def region_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("-", region_label(F.least(a, b)), region_label(F.greatest(a, b)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
