"""Rank-sum tests, AUC, rank correlation and FDR adjustment over long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoframe.functions.tails import EXACT_LIMIT, correlation_p, rank_sum_p
from clonoframe.operators.running import running_minimum_from_top, running_totals
from clonoframe.session import cut_lineage

DIGITS = 9
#: A value is common when it holds more than this share of the rows; so there are fewer.
HOT_SHARE = 64


def melt(wide: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, value) with values as rounded doubles, so ties are exact."""
    cast = wide.select(*keys, *[F.round(F.col(c).cast("double"), DIGITS).alias(c) for c in columns])
    return cast.unpivot(list(keys), list(columns), "feature", "value")


def value_histogram(
    rows: DataFrame, by: Sequence[str], value: str, inside: Column, weight: Column | None = None
) -> DataFrame:
    """Rows in and out of the tested group per distinct value."""
    w = weight if weight is not None else F.lit(1)
    return rows.groupBy(*by, F.col(value).alias("value")).agg(
        F.sum(F.when(inside, w).otherwise(0)).cast("long").alias("n_in"),
        F.sum(F.when(~inside, w).otherwise(0)).cast("long").alias("n_out"),
    )


def rank_statistics(hist: DataFrame, by: Sequence[str], pvalue: bool = True) -> DataFrame:
    """U, AUC, tie term and two-sided p of each test, ranking its histogram over value ranges."""
    by = list(by)
    hist = hist.withColumn("t", F.col("n_in") + F.col("n_out"))
    ranked = running_totals(hist, by, "value", {"upto": "t"})
    t = F.col("t").cast("double")
    before = F.col("upto") - F.col("t")
    midrank = before + (t + 1) / 2
    # blocks starting below the exact-test limit: at most that many rows per test
    block = F.when(before < 2 * EXACT_LIMIT, F.struct(before.alias("at"), F.col("t").alias("t")))
    aggs = [
        F.sum("n_in").alias("n_in"),
        F.sum("n_out").alias("n_out"),
        F.sum(F.col("n_in") * midrank).alias("_ranks"),
        F.sum(t * t * t - t).alias("tie_term"),
    ]
    if pvalue:
        aggs.append(F.sort_array(F.collect_list(block)).alias("_blocks"))
    tested = ranked.groupBy(*by).agg(*aggs)
    a, b = F.col("n_in").cast("double"), F.col("n_out").cast("double")
    u = F.col("_ranks") - a * (a + 1) / 2
    out = tested.select(
        *by,
        "n_in",
        "n_out",
        u.alias("u"),
        F.try_divide(u, a * b).alias("auc"),
        "tie_term",
        z_score(u, a, b, F.col("tie_term")).alias("z"),
        *([F.transform("_blocks", lambda s: s["t"]).alias("_blocks")] if pvalue else []),
    )
    if not pvalue:
        return out
    return out.withColumn("pval", rank_sum_p("n_in", "n_out", "u", "tie_term", "_blocks")).drop(
        "_blocks"
    )


def z_score(u: Column, a: Column, b: Column, tie_term: Column) -> Column:
    n = a + b
    spread = a * b / 12 * ((n + 1) - F.coalesce(F.try_divide(tie_term, n * (n - 1)), F.lit(0.0)))
    gap = F.greatest(F.lit(0.0), F.abs(u - a * b / 2) - 0.5)
    return F.when(spread > 0, F.signum(u - a * b / 2) * F.try_divide(gap, F.sqrt(spread))).otherwise(0.0)


def adjust_fdr(
    tests: DataFrame, p: str = "pval", out: str = "padj", drop_na: bool = False
) -> DataFrame:
    """Benjamini-Hochberg step-up over every emitted test, ranked over ranges of p.

    Equal p values share one position; a null p stays null. The tests are read four times, so they
    are checkpointed.
    """
    tests = cut_lineage(tests)
    rows = tests.filter(F.col(p).isNotNull()) if drop_na else tests
    known = rows.filter(F.col(p).isNotNull())
    hist = known.groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_m"))
    total = known.agg(F.count(F.lit(1))).scalar()
    ranked = running_totals(hist, [], "_p", {"_upto": "_m"})
    ranked = ranked.withColumn("_raw", F.col("_p") * total / F.col("_upto"))
    steps = running_minimum_from_top(ranked, "_p", "_raw", "_q").select(
        "_p", F.least(F.col("_q"), F.lit(1.0)).alias(out)
    )
    return rows.join(steps, F.col(p) == F.col("_p"), "left").drop("_p")


def group_against_rest(
    rows: DataFrame, groups: Sequence[str], value: str = "value", group: str = "group"
) -> DataFrame:
    """Statistics per (feature, group) of one group against all others.

    One aggregation counts every group per distinct value; "the rest" is the total minus
    the group, so no group is compared through a join.
    """
    labelled = rows.filter(F.col(group).isNotNull())

    def per_group(count_all: Column, count_one) -> Column:
        """Array over the groups of (name, inside, outside)."""
        return F.array(
            *[
                F.struct(
                    F.lit(g).alias("g"),
                    count_one(F.col(group) == g).alias("inside"),
                    (count_all - count_one(F.col(group) == g)).alias("outside"),
                )
                for g in groups
            ]
        )

    counts = labelled.groupBy("feature", F.col(value).alias("value")).agg(
        per_group(F.count(F.lit(1)), lambda f: F.sum(f.cast("long"))).alias("_g")
    )
    hist = counts.select("feature", "value", F.explode("_g").alias("_g")).select(
        "feature",
        F.col("_g.g").alias(group),
        "value",
        F.col("_g.inside").alias("n_in"),
        F.col("_g.outside").alias("n_out"),
    )
    sums = labelled.groupBy("feature").agg(
        per_group(
            F.sum(value), lambda f: F.sum(F.when(f, F.col(value)).otherwise(0.0))
        ).alias("_g")
    )
    sums = sums.select("feature", F.explode("_g").alias("_g")).select(
        "feature", F.col("_g.g").alias(group), F.col("_g.inside").alias("_s_in"),
        F.col("_g.outside").alias("_s_out"),
    )
    usable = (F.col("n_in") >= 2) & (F.col("n_out") >= 2)
    mean_in = F.try_divide(F.col("_s_in"), F.col("n_in"))
    mean_out = F.try_divide(F.col("_s_out"), F.col("n_out"))
    return (
        rank_statistics(hist, ["feature", group])
        .filter(usable)
        .join(sums, ["feature", group])
        .withColumn("mean_in", mean_in)
        .withColumn("mean_out", mean_out)
        .withColumn("mean_diff", mean_in - mean_out)
        .drop("_s_in", "_s_out")
    )


def group_names(features: DataFrame, group: str = "group") -> list[str]:
    """Distinct group labels of a sample table."""
    rows = features.filter(F.col(group).isNotNull()).select(group).distinct().orderBy(group)
    return [r[group] for r in rows.collect()]


def _with_rank(rows: DataFrame, ranks: DataFrame, name: str, names: Sequence[str]) -> DataFrame:
    """Add ``rank_<name>``. The rows of a common value are dealt to ``_parts`` tasks, which each get its rank."""
    mine = ranks.filter(F.col("feature") == name).select(
        F.col("value").alias(name), F.col("rank").alias(f"rank_{name}"), "_parts"
    )
    common = F.broadcast(mine.filter("_parts > 1").select(name, "_parts"))  # fewer than HOT_SHARE
    part = F.coalesce(F.pmod(F.xxhash64(*names), F.col("_parts")), F.lit(0).cast("long"))
    dealt = rows.join(common, name, "left").withColumn("_part", part).drop("_parts")
    every = mine.withColumn("_part", F.explode(F.expr("sequence(0L, _parts - 1)"))).drop("_parts")
    return dealt.join(every, [name, "_part"]).drop("_part")


def rank_correlation(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Spearman correlation and p of column pairs, ranking each column over value ranges.

    Rows that agree in all columns are one row with a weight.
    """
    names = sorted({c for pair in pairs for c in pair})
    rounded = rows.select(*[F.round(F.col(c).cast("double"), DIGITS).alias(c) for c in names])
    distinct = cut_lineage(rounded.groupBy(*names).agg(F.count(F.lit(1)).alias("_m")))
    long = distinct.unpivot(["_m"], names, "feature", "value")
    hist = long.groupBy("feature", "value").agg(F.sum("_m").alias("t"), F.count(F.lit(1)).alias("_c"))
    upto = running_totals(hist, ["feature"], "value", {"upto": "t"})
    total = distinct.count()
    parts = (1 + F.floor(F.col("_c") * HOT_SHARE / max(total, 1))).cast("long").alias("_parts")
    ranks = cut_lineage(
        upto.select("feature", "value", (F.col("upto") - (F.col("t") - 1) / 2).alias("rank"), parts)
    )
    ranked = distinct
    for name in names:
        ranked = _with_rank(ranked, ranks, name, names)
    # ranks are centred and scaled before they are squared
    w = F.col("_m").cast("double")
    whole = distinct.agg(F.sum("_m")).first()[0] or 0

    def unit(name: str) -> Column:
        return (F.col(f"rank_{name}") - (whole + 1) / 2) / max(whole, 1)

    sums = [F.sum(w * unit(c)).alias(f"_s_{c}") for c in names]
    sums += [F.sum(w * unit(c) * unit(c)).alias(f"_q_{c}") for c in names]
    sums += [F.sum(w * unit(x) * unit(y)).alias(f"_x_{x}|{y}") for x, y in pairs]
    counted = ranked.agg(F.coalesce(F.sum("_m"), F.lit(0).cast("long")).alias("n"), *sums)

    def rho(x: str, y: str) -> Column:
        n = F.col("n")
        joint = n * F.col(f"_x_{x}|{y}") - F.col(f"_s_{x}") * F.col(f"_s_{y}")
        own = [n * F.col(f"_q_{c}") - F.col(f"_s_{c}") * F.col(f"_s_{c}") for c in (x, y)]
        return F.try_divide(joint, F.sqrt(own[0]) * F.sqrt(own[1])).alias(f"{x}|{y}")

    counted = counted.select("n", *[rho(x, y) for x, y in pairs])
    tall = counted.unpivot(["n"], [f"{x}|{y}" for x, y in pairs], "pair", "rho")
    return tall.select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("axis"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("property"),
        "n",
        "rho",
        correlation_p("rho", "n").alias("pval"),
    )


def cohens_d(rows: DataFrame, by: Sequence[str], value: str, inside: Column,
             epsilon: float = 1e-10) -> DataFrame:
    """Standardised mean difference with population deviations."""
    x, y = F.when(inside, F.col(value)), F.when(~inside, F.col(value))
    spread = (F.var_pop(x) + F.var_pop(y)) / 2 + epsilon
    return rows.groupBy(*by).agg(((F.avg(x) - F.avg(y)) / F.sqrt(spread)).alias("cohens_d"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
