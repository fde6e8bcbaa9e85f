"""Comparison of a clustering with labels, from one contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoframe.functions.tails import fisher_p


def agreement(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean)."""
    cells = rows.groupBy(cluster, label).agg(F.count(F.lit(1)).cast("double").alias("m"))
    m = F.col("m")

    def pairs(x):
        return x * (x - 1) / 2

    def xlogx(x):
        return F.when(x > 0, x * F.ln(x)).otherwise(0.0)

    def margin(key: str, tag: str) -> DataFrame:
        sums = cells.groupBy(key).agg(F.sum("m").alias("m"))
        return sums.agg(
            F.sum(pairs(m)).alias(f"p_{tag}"),
            F.sum(xlogx(m)).alias(f"h_{tag}"),
            F.sum("m").alias(f"n_{tag}"),
        ).withColumn("_k", F.lit(1))

    inside = cells.agg(
        F.sum(pairs(m)).alias("p_both"), F.sum(xlogx(m)).alias("h_both")
    ).withColumn("_k", F.lit(1))
    # three one-row tables
    one = inside.join(margin(cluster, "a"), "_k").join(margin(label, "b"), "_k")
    n = F.col("n_a")
    expected = F.try_divide(F.col("p_a") * F.col("p_b"), pairs(n))
    best = (F.col("p_a") + F.col("p_b")) / 2
    ha = F.ln(n) - F.col("h_a") / n
    hb = F.ln(n) - F.col("h_b") / n
    hab = F.ln(n) - F.col("h_both") / n
    mean_h = (ha + hb) / 2
    return one.select(
        F.when(best == expected, 1.0)
        .otherwise(F.try_divide(F.col("p_both") - expected, best - expected))
        .alias("ari"),
        F.when(mean_h > 0, (ha + hb - hab) / mean_h).otherwise(1.0).alias("nmi"),
    )


def composition(rows: DataFrame, cluster: str = "cluster", case: str = "case") -> DataFrame:
    """Per cluster: size, case share, enrichment over the overall share, Fisher test."""
    is_case = (F.col("group") == case).cast("long")
    per = rows.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(is_case).alias("n_case")
    )
    total = per.agg(
        F.struct(F.sum("n_samples").alias("n"), F.sum("n_case").alias("case"))
    ).scalar()
    t = per.withColumn("_t", total).withColumn("n_control", F.col("n_samples") - F.col("n_case"))
    a, b = F.col("n_case"), F.col("n_control")
    c = F.col("_t.case") - a
    d = (F.col("_t.n") - F.col("_t.case")) - b
    share, overall = a / F.col("n_samples"), F.try_divide(F.col("_t.case"), F.col("_t.n"))
    return t.select(
        cluster,
        "n_samples",
        "n_case",
        "n_control",
        share.alias("case_frac"),
        (share / (overall + 1e-6)).alias("enrichment"),
        F.try_divide(a.cast("double") * d, b.cast("double") * c).alias("odds_ratio"),
        fisher_p(a, b, c, d).alias("p_value"),
        F.when(share > overall, "case-enriched").otherwise("control-enriched").alias("enriched_in"),
    )
