"""Domain-level comparison of two groups of sequences, and axis diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoframe.functions import sequence as Q
from clonoframe.functions.tails import fisher_p
from clonoframe.operators import ranktests as R
from clonoframe.operators.running import running_totals
from clonoframe.session import cut_lineage

DOMAINS = {
    "length_class": "CDR3 Length",
    "charge_class": "Net Charge",
    "hydro_class": "Hydrophobicity",
    "aromatic_class": "Aromatic",
}


def sequence_map(clones: DataFrame) -> DataFrame:
    """One row per clone record with map properties and the four classes."""
    base = clones.select("*", *[c.alias(n) for n, c in Q.map_columns("cdr3_aa").items()])
    classes = Q.domain_classes(
        F.col("length"), F.col("net_charge"), F.col("hydrophobicity"), F.col("aromatic_frac")
    )
    return base.select("*", *[c.alias(n) for n, c in classes.items()])


def domain_counts(
    rows: DataFrame, case: str = "case", control: str = "control", group: str = "group"
) -> DataFrame:
    """n_case and n_control of each (domain, category), plus the group totals.

    The four class columns are counted together first (at most 81 combinations), then
    unpivoted.
    """
    cube = rows.filter(F.col(group).isin(case, control)).groupBy(*DOMAINS).agg(
        F.sum((F.col(group) == case).cast("long")).alias("n_case"),
        F.sum((F.col(group) == control).cast("long")).alias("n_control"),
    )
    tall = cube.unpivot(["n_case", "n_control"], list(DOMAINS), "domain", "category")
    named = F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])
    counts = tall.withColumn("domain", named[F.col("domain")]).groupBy("domain", "category").agg(
        F.sum("n_case").alias("n_case"), F.sum("n_control").alias("n_control")
    )
    total = cube.agg(
        F.struct(F.sum("n_case").alias("case"), F.sum("n_control").alias("control"))
    ).scalar()
    return counts.withColumn("_t", total).select(
        "domain", "category", "n_case", "n_control",
        F.col("_t.case").alias("total_case"), F.col("_t.control").alias("total_control"),
    )


def domain_significance(rows: DataFrame, case="case", control="control", group="group") -> DataFrame:
    """Fisher test, odds ratio with 95 % Woolf interval, and stars per category."""
    counts = domain_counts(rows, case, control, group)
    a, b = F.col("n_case"), F.col("n_control")
    c, d = F.col("total_case") - a, F.col("total_control") - b
    odds = F.try_divide(a.cast("double") * d, b.cast("double") * c)
    error = F.sqrt(sum((F.try_divide(F.lit(1.0), x) for x in (a, b, c, d)), F.lit(0.0)))
    filled = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    tests = counts.select(
        "domain", "category", "n_case", "n_control",
        F.when((b > 0) & (c > 0), F.round(odds, 4)).alias("odds_ratio"),
        F.when(filled, F.exp(F.ln(odds) - 1.96 * error)).alias("ci_low"),
        F.when(filled, F.exp(F.ln(odds) + 1.96 * error)).alias("ci_high"),
        fisher_p(a, b, c, d).alias("p_value"),
    )
    return tests.withColumn("significant", R.stars(F.col("p_value")))


def frequency_redistribution(rows: DataFrame, case="case", control="control") -> DataFrame:
    """Per category: share of case, share of control, and their ratio."""
    counts = domain_counts(rows, case, control)
    fc = F.try_divide(F.col("n_case"), F.col("total_case"))
    fk = F.try_divide(F.col("n_control"), F.col("total_control"))
    return counts.select(
        "domain", "category", fc.alias("case_freq"), fk.alias("control_freq"),
        (fc / (fk + 1e-6)).alias("ratio"),
    )


def family_shares(
    rows: DataFrame, families: Sequence[str] | None = None, case="case", control="control"
) -> DataFrame:
    """V-family shares in both groups and their log2 ratio."""
    counts = rows.groupBy(Q.gene_family("v_gene").alias("v_family")).agg(
        F.sum((F.col("group") == case).cast("long")).alias("n_case"),
        F.sum((F.col("group") == control).cast("long")).alias("n_control"),
    )
    total = counts.agg(
        F.struct(F.sum("n_case").alias("case"), F.sum("n_control").alias("control"))
    ).scalar()
    shares = counts.withColumn("_t", total).select(
        "v_family",
        F.try_divide(F.col("n_case"), F.col("_t.case")).alias("case_freq"),
        F.try_divide(F.col("n_control"), F.col("_t.control")).alias("control_freq"),
    )
    if families is not None:
        shares = shares.filter(F.col("v_family").isin(list(families)))
    ratio = F.col("case_freq") / (F.col("control_freq") + 1e-6)
    return shares.withColumn("log2_ratio", F.when(ratio > 0, F.log2(ratio)))


def motif_by_group(rows: DataFrame, motifs: Sequence[str], case="case", control="control"):
    """Rows holding each motif per group, and the case/control ratio."""
    hits = rows.select(
        "group",
        *[F.col("cdr3_aa").contains(m).alias(m) for m in motifs],
    ).groupBy("group").agg(*[F.sum(F.col(m).cast("long")).alias(m) for m in motifs])
    tall = hits.unpivot(["group"], list(motifs), "motif", "n")
    counts = tall.groupBy("motif").agg(
        F.sum(F.when(F.col("group") == case, F.col("n")).otherwise(0)).alias("n_case"),
        F.sum(F.when(F.col("group") == control, F.col("n")).otherwise(0)).alias("n_control"),
    )
    return counts.withColumn(
        "ratio", F.col("n_case") / F.greatest(F.col("n_control"), F.lit(1))
    )


def expansion_gradient(rows: DataFrame, count: str = "count", case="case", control="control",
                       pvalue: bool = True):
    """Mean log1p(count) of both groups and their rank test."""
    kept = rows.filter(F.col("group").isin(case, control))
    inside = F.col("group") == case
    # log1p is monotone: ranking the integer counts gives the same test
    hist = R.value_histogram(kept.withColumn("test", F.lit("expansion")), ["test"], count, inside)
    means = hist.groupBy("test").agg(
        F.try_divide(F.sum(F.col("n_in") * F.log1p("value")), F.sum("n_in")).alias("case_mean"),
        F.try_divide(F.sum(F.col("n_out") * F.log1p("value")), F.sum("n_out")).alias(
            "control_mean"
        ),
    )
    return means.join(R.rank_statistics(hist, ["test"], pvalue=pvalue), "test").drop(
        "test"
    )


def axis_correlation(rows: DataFrame, axes: Sequence[str], properties: Sequence[str]) -> DataFrame:
    return R.rank_correlation(rows, [(a, p) for a in axes for p in properties])


def axis_auc(rows: DataFrame, axes: Sequence[str], case="case") -> DataFrame:
    """AUC of each axis as a sequence-level score, with the conclusion drawn from both."""
    labelled = rows.filter(F.col("group").isNotNull())
    long = R.melt(labelled, ["group"], axes)
    hist = R.value_histogram(long, ["feature"], "value", F.col("group") == case)
    scores = R.rank_statistics(hist, ["feature"], pvalue=False)
    best = scores.agg(F.max("auc")).scalar()
    return scores.select(
        F.col("feature").alias("axis"),
        F.coalesce("auc", F.lit(0.5)).alias("auc"),
        F.when(best < 0.55, "population-level").otherwise("sequence-level signal").alias("conclusion"),
    )


def centroid_shift(rows: DataFrame, axis: str, case="case", control="control",
                   pvalue: bool = True) -> DataFrame:
    """Shift of the group means along an axis and the overlap of their distributions.

    The overlap is the mean over control points of min(F, 1 - F), where F is the case
    distribution interpolated linearly between its order statistics (i/(n-1) at the i-th).
    For a control point between two adjacent distinct case values, F follows from the case
    rows at or below each of them; both come from one running total over the merged values.
    """
    kept = rows.filter(F.col("group").isin(case, control))
    inside = F.col("group") == case
    long = R.melt(kept, ["group"], [axis])
    hist = R.value_histogram(long, ["feature"], "value", inside)
    mass = {"case_upto": "n_in", "_ord": "_one"}
    # neighbours among distinct case values: running position of case values, joined on it
    marked = hist.withColumn("_one", (F.col("n_in") > 0).cast("long"))
    placed = cut_lineage(running_totals(marked, [], "value", mass))
    size = placed.agg(F.sum("n_in")).scalar().cast("double")
    knots = placed.filter(F.col("n_in") > 0)
    low = knots.select(
        F.col("_ord").alias("_lo"), F.col("value").alias("x0"), (F.col("case_upto") - 1).alias("y0")
    )
    high = knots.select(
        (F.col("_ord") - 1).alias("_hi"),
        F.col("value").alias("x1"),
        (F.col("case_upto") - F.col("n_in")).alias("y1"),
    )
    points = (
        placed.filter(F.col("n_out") > 0)
        .select("feature", "value", "n_out", "_ord")
        .join(low, F.col("_ord") == F.col("_lo"), "left")
        .join(high, F.col("_ord") == F.col("_hi"), "left")
    )
    between = F.col("y0") + (F.col("y1") - F.col("y0")) * (
        F.try_divide(F.col("value") - F.col("x0"), F.col("x1") - F.col("x0"))
    )
    step = (
        F.when(F.col("x0").isNull(), 0.0)
        .when(F.col("value") == F.col("x0"), F.col("y0"))
        .when(F.col("x1").isNull(), size - 1)
        .otherwise(between)
    )
    level = F.when(size > 1, step / (size - 1)).otherwise(0.0)
    overlap = points.withColumn("_f", level).groupBy("feature").agg(
        (
            F.sum(F.col("n_out") * F.least(F.col("_f"), 1 - F.col("_f"))) / F.sum("n_out")
        ).alias("overlap")
    )
    means = placed.groupBy("feature").agg(
        F.abs(
            F.sum(F.col("n_in") * F.col("value")) / F.sum("n_in")
            - F.sum(F.col("n_out") * F.col("value")) / F.sum("n_out")
        ).alias("shift")
    )
    tests = R.rank_statistics(placed.select("feature", "value", "n_in", "n_out"), ["feature"],
                              pvalue=pvalue)
    return means.join(overlap, "feature").join(tests, "feature").withColumnRenamed(
        "feature", "axis"
    )


def modified_peptides(pairs: DataFrame, digits: int = 3) -> DataFrame:
    """Charge and hydropathy of native and modified peptides and their differences.

    ``pairs`` is (name, native, modified); X stands for the modified residue with charge 0
    and hydropathy 0.5.
    """

    def hydro(c: str) -> Column:
        plain = Q.hydropathy(c, unknown_as_zero=True)
        return plain + Q.share(Q.residue_count(c, "X") * 5, F.length(c) * 10)

    native, changed = Q.net_charge("native"), Q.net_charge("modified")
    return pairs.select(
        "name",
        native.alias("native_charge"),
        changed.alias("modified_charge"),
        F.round(hydro("native"), digits).alias("native_hydro"),
        F.round(hydro("modified"), digits).alias("modified_hydro"),
        (changed - native).alias("delta_charge"),
        F.round(hydro("modified") - hydro("native"), digits).alias("delta_hydro"),
    )


def property_comparison(rows: DataFrame, properties: Sequence[str], inside: Column) -> DataFrame:
    """Rank test of each property between two sequence sets, whole sets."""
    long = R.melt(rows.withColumn("_in", inside), ["_in"], properties)
    hist = R.value_histogram(long, ["feature"], "value", F.col("_in"))
    tests = R.rank_statistics(hist, ["feature"])
    return tests.withColumn("stars", R.stars(F.col("pval")))
