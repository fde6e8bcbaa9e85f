"""Count spectra: how many clone records of a sample have each read count.

Records with the same count are interchangeable for every count-based statistic, so ranks,
cumulative shares and moments are taken over the spectrum. A sample with N reads has at
most sqrt(2N) distinct counts, which bounds the rows a window over one sample can hold
however large the sample is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clonoframe.functions.sequence import adjusted_kurtosis, adjusted_skew

EXACT_RANKS = 32


def count_spectrum(clones: DataFrame, key: str = "sample_id", count: str = "count") -> DataFrame:
    """(key, size, m, before, reads_before, n, reads), ranks counted from the largest size."""
    spectrum = clones.groupBy(key, F.col(count).alias("size")).agg(F.count(F.lit(1)).alias("m"))
    down = W.partitionBy(key).orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(key)
    mass = F.col("size") * F.col("m")
    return spectrum.select(
        key,
        "size",
        "m",
        (F.sum("m").over(down) - F.col("m")).alias("before"),
        (F.sum(mass).over(down) - mass).alias("reads_before"),
        F.sum("m").over(whole).alias("n"),
        F.sum(mass).over(whole).alias("reads"),
    )


def _log_tail(x: Column) -> Column:
    """Euler-Maclaurin antiderivative of ln r, endpoint terms included."""
    ln = F.ln(x)
    return x * ln - x + ln / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)


def _log_square_tail(x: Column) -> Column:
    """Euler-Maclaurin antiderivative of (ln r)^2, endpoint terms included."""
    ln = F.ln(x)
    third = (4 * ln - 6) / (x * x * x)
    return x * (ln * ln - 2 * ln + 2) + ln * ln / 2 + ln / (6 * x) - third / 720


def _prefix(power: int) -> list[float]:
    sums = [0.0]
    for rank in range(1, EXACT_RANKS + 1):
        sums.append(sums[-1] + math.log(rank) ** power)
    return sums


def log_rank_sums(before: Column, m: Column) -> tuple[Column, Column]:
    """Sums of ln(rank) and ln(rank)^2 over the ranks before+1 ... before+m.

    Small ranks come from a table; the rest from the Euler-Maclaurin expansion, whose
    error beyond rank 32 is below 1e-10.
    """
    last = before + m
    limit = F.lit(EXACT_RANKS)

    def block(power: int, tail) -> Column:
        table = F.expr(f"array({', '.join(f'{v!r}D' for v in _prefix(power))})")
        near = F.element_at(table, (F.least(last, limit) + 1).cast("int")) - F.element_at(
            table, (F.least(before, limit) + 1).cast("int")
        )
        low = F.greatest(before, limit).cast("double")
        high = F.greatest(last, limit).cast("double")
        return near + F.when(last > limit, tail(high) - tail(low)).otherwise(0.0)

    return block(1, _log_tail), block(2, _log_square_tail)


def reach_rank(share: float) -> Column:
    """Smallest number of top records holding ``share`` of the reads (null outside the block)."""
    size, goal = F.col("size"), F.lit(share) * F.col("reads")
    start = F.col("reads_before")
    inside = (start < goal) & (start + size * F.col("m") >= goal - F.lit(1e-9) * F.col("reads"))
    steps = F.greatest(F.lit(1), F.ceil(F.try_divide(goal - start, size) - F.lit(1e-9)))
    return F.when(inside, F.col("before") + steps)


def spectrum_statistics(spectrum: DataFrame, key: str = "sample_id") -> DataFrame:
    """All count-based statistics of a sample in one aggregation over its spectrum."""
    size, m, n, reads = (F.col(c).cast("double") for c in ("size", "m", "n", "reads"))
    before = F.col("before").cast("double")
    positive = F.col("size") > 0
    ln_size = F.when(positive, F.ln(size)).otherwise(0.0)
    share = F.try_divide(size, reads)
    log_sum, log_square = log_rank_sums(F.col("before"), F.col("m"))

    def over_positive(value: Column) -> Column:
        return F.sum(F.when(positive, value))

    kept = F.greatest(F.lit(0.0), F.least(F.lit(5.0), before + m) - before)
    base = spectrum.groupBy(key).agg(
        F.max("n").alias("n"),
        F.max("reads").alias("reads"),
        F.max(size).alias("top"),
        F.sum(m * size * ln_size).alias("s_clnc"),
        F.sum(m * size * size).alias("s_cc"),
        over_positive(m).alias("n_pos"),
        over_positive(m * size).alias("s_c_pos"),
        over_positive(size * (m * before + m * (m + 1) / 2)).alias("s_rank_c"),
        over_positive(log_sum).alias("s_x"),
        over_positive(log_square).alias("s_xx"),
        over_positive(m * ln_size).alias("s_y"),
        over_positive(ln_size * log_sum).alias("s_xy"),
        F.min(reach_rank(0.5)).alias("d50_index"),
        F.min(reach_rank(0.2)).alias("d20_index"),
        F.sum(F.when(share > 0.01, F.col("m")).otherwise(0)).alias("hec_1pct"),
        F.sum(F.when(share > 0.05, F.col("m")).otherwise(0)).alias("hec_5pct"),
        F.sum(F.when(share > 0.01, m * share).otherwise(0.0)).alias("hec_sum_freq"),
        F.try_divide(F.sum(kept * size), F.max(reads)).alias("top5_freq"),
    )
    total, rows = F.col("reads").cast("double"), F.col("n").cast("double")
    entropy = F.ln(total) - F.try_divide(F.col("s_clnc"), total)
    squares = F.try_divide(F.col("s_cc"), total * total)
    pos = F.col("n_pos")
    slope = F.try_divide(
        pos * F.col("s_xy") - F.col("s_x") * F.col("s_y"),
        pos * F.col("s_xx") - F.col("s_x") * F.col("s_x"),
    )
    # ascending rank = n + 1 - descending rank
    rank_mass = (pos + 1) * F.col("s_c_pos") - F.col("s_rank_c")
    return base.select(
        key,
        "n",
        "reads",
        entropy.alias("shannon"),
        (1 - squares).alias("simpson"),
        F.when(rows > 1, 1 - F.try_divide(entropy, F.ln(rows))).alias("clonality"),
        F.when(pos >= 5, -slope).alias("powerlaw_a"),
        F.when(
            pos > 0, F.try_divide(2 * rank_mass, pos * F.col("s_c_pos")) - F.try_divide(pos + 1, pos)
        ).alias("gini"),
        F.try_divide(F.col("top"), total).alias("top_clone_frac"),
        "top5_freq",
        "d50_index",
        "d20_index",
        "hec_1pct",
        "hec_5pct",
        "hec_sum_freq",
        F.when(
            total > 1, F.try_divide(rows * (F.col("s_cc") - total), total * (total - 1))
        ).alias("morisita"),
        F.try_divide(F.col("top"), total).alias("berger_parker"),
        F.when(pos > 1, F.try_divide(entropy, F.ln(pos))).alias("pielou_evenness"),
        (-F.ln(squares)).alias("renyi_q2"),
    )


def renyi(order: float) -> Column:
    """Renyi entropy of a frequency column, as an aggregate (order 1 is Shannon)."""
    p = F.col("freq")
    if order == 1:
        return -F.sum(F.when(p > 0, p * F.ln(p)))
    return F.ln(F.sum(F.when(p > 0, F.pow(p, F.lit(float(order)))))) / F.lit(1.0 - order)


def count_moments(clones: DataFrame, key: str = "sample_id", compat: bool = False) -> DataFrame:
    """Skewness and kurtosis of log10(count + 1)."""
    value = F.log10(F.col("count") + 1)
    base = clones.groupBy(key).agg(
        F.count(value).cast("double").alias("_n"),
        F.skewness(value).alias("_g1"),
        F.kurtosis(value).alias("_g2"),
    )
    return base.select(
        key,
        adjusted_skew(F.col("_n"), F.col("_g1")).alias("count_skewness"),
        adjusted_kurtosis(F.col("_n"), F.col("_g2"), compat).alias("count_kurtosis"),
    )


def frequency_statistics(clones: DataFrame, key: str = "sample_id") -> DataFrame:
    """The frequency-based columns for tables that bring their own ``freq``.

    Samples whose ``freq`` is entirely null fall back to count shares, from the spectrum.
    """
    p = F.col("freq")
    own = clones.groupBy(key).agg(
        F.count(p).alias("_known"),
        renyi(1).alias("_shannon"),
        (1 - F.sum(p * p)).alias("_simpson"),
        F.max(p).alias("_top_clone_frac"),
        F.sum((p > 0).cast("double")).alias("_pos"),
        F.sum((p > 0.01).cast("long")).alias("_hec_1pct"),
        F.sum((p > 0.05).cast("long")).alias("_hec_5pct"),
        F.sum(F.when(p > 0.01, p).otherwise(0.0)).alias("_hec_sum_freq"),
        renyi(2).alias("_renyi_q2"),
    )
    base = spectrum_statistics(count_spectrum(clones, key), key)
    joined = base.join(own, key)
    given = F.col("_known") > 0
    rows = F.col("n").cast("double")
    replaced = {
        "clonality": F.when(rows > 1, 1 - F.try_divide(F.col("_shannon"), F.ln(rows))),
        "pielou_evenness": F.when(F.col("_pos") > 1, F.try_divide(F.col("_shannon"), F.ln("_pos"))),
    }
    for name in ("shannon", "simpson", "top_clone_frac", "hec_1pct", "hec_5pct",
                 "hec_sum_freq", "renyi_q2"):
        replaced[name] = F.col(f"_{name}")
    picked = [
        F.when(given, replaced[c]).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c)
        for c in base.columns
    ]
    return joined.select(*picked)
