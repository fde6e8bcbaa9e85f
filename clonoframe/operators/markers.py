"""Marker discovery: feature-level rank tests, k-mer enrichment, prototype markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoframe.functions.sequence import explode_kmers
from clonoframe.functions.tails import fisher_p
from clonoframe.operators import ranktests as R
from clonoframe.session import cut_lineage


def statistical_markers(
    features: DataFrame, columns: Sequence[str], fdr: float = 0.05, group: str = "group"
) -> DataFrame:
    """Every feature against every group with at least two samples on both sides, by padj."""
    features = cut_lineage(features.select("sample_id", group, *columns))
    rows = R.melt(features, ["sample_id", group], columns)
    tests = R.group_against_rest(rows, R.group_names(features, group), group=group)
    out = R.adjust_fdr(tests)
    return out.withColumn("significant", F.col("padj") < fdr).orderBy("padj", "feature", group)


def kmer_counts(clones: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """Occurrences of each k-mer per key; a sequence that repeats is cut into k-mers once."""
    repeats = clones.groupBy(*by, "cdr3_aa").agg(F.count(F.lit(1)).alias("_times"))
    words = explode_kmers(repeats, k, *by, "_times")
    return words.groupBy(*by, "kmer").agg(F.sum("_times").alias("n"))


def sequence_markers(
    clones: DataFrame, k: int = 3, fdr: float = 0.05, min_count: int = 3, group: str = "group"
) -> DataFrame:
    """k-mer enrichment of each group against the rest, FDR over all groups jointly.

    The largest odds ratios come first.

    The number of groups is small; k-mers are bounded by alphabet^k, so everything after
    the first aggregation is vocabulary-sized.
    """
    labelled = clones.filter(F.col(group).isNotNull())
    per = cut_lineage(kmer_counts(labelled, k, [group]))
    enough = (
        labelled.select(group, "sample_id").distinct().groupBy(group)
        .agg(F.count(F.lit(1)).alias("n_samples"))
        .filter(F.col("n_samples") >= 2)
    )
    sums = per.groupBy(group).agg(F.sum("n").alias("group_total"))
    everything = per.agg(F.sum("n")).scalar()
    by_kmer = per.groupBy("kmer").agg(F.sum("n").alias("n_all"))
    tests = (
        per.filter(F.col("n") >= min_count)
        .join(by_kmer, "kmer")
        .join(sums, group)
        .join(enough, group)
        .select(
            F.col("kmer").alias("motif"),
            group,
            F.col("n").alias("count_in"),
            (F.col("n_all") - F.col("n")).alias("count_out"),
            (F.col("group_total") - F.col("n")).alias("b"),
            (everything - F.col("group_total") - F.col("n_all") + F.col("n")).alias("d"),
        )
    )
    odds = (F.col("count_in").cast("double") * F.col("d")) / (
        F.col("b").cast("double") * F.col("count_out") + 1e-9
    )
    scored = tests.withColumn("odds_ratio", odds).withColumn(
        "pval", fisher_p("count_in", "b", "count_out", "d")
    )
    out = R.adjust_fdr(scored.drop("b", "d"))
    out = out.withColumn("significant", (F.col("padj") < fdr) & (F.col("odds_ratio") > 1))
    return out.orderBy(F.desc("odds_ratio"), "motif", group)


def prototype_markers(
    counts: DataFrame,
    labels: DataFrame,
    prototypes: DataFrame,
    min_expressed: float = 0.05,
) -> DataFrame:
    """Case/control test per prototype over a long count table.

    ``counts`` (sample_id, prototype, count) holds non-zero cells only. Absent cells are one
    tie block at zero whose size per side is samples minus non-zero rows, so the matrix is
    never densified. ``labels`` is (sample_id, label 0/1).
    """
    counts, labels = cut_lineage(counts), cut_lineage(labels)
    size = labels.agg(
        F.struct(
            F.sum((F.col("label") == 1).cast("long")).alias("case"),
            F.sum((F.col("label") == 0).cast("long")).alias("control"),
        )
    ).scalar()
    sides = prototypes.select("prototype", size.alias("size")).select(
        "prototype", F.col("size.case").alias("n_case"), F.col("size.control").alias("n_control")
    )
    cells = counts.filter(F.col("count") > 0).join(labels, "sample_id")
    case = F.col("label") == 1
    sums = cells.groupBy("prototype").agg(
        F.count(F.lit(1)).alias("nnz"),
        F.sum(case.cast("long")).alias("nnz_case"),
        F.sum(F.when(case, F.col("count")).otherwise(0)).alias("s_case"),
        F.sum(F.when(~case, F.col("count")).otherwise(0)).alias("s_control"),
    )
    base = sides.join(sums, "prototype", "left").na.fill(0)
    zero = base.select(
        "prototype",
        F.lit(0).cast("long").alias("value"),
        (F.col("n_case") - F.col("nnz_case")).alias("n_in"),
        (F.col("n_control") - (F.col("nnz") - F.col("nnz_case"))).alias("n_out"),
    ).filter((F.col("n_in") > 0) | (F.col("n_out") > 0))
    positive = R.value_histogram(
        cells.withColumn("value", F.col("count").cast("long")), ["prototype"], "value", case
    )
    # integer counts: distinct values per prototype are at most sqrt(2 x reads)
    tests = R.rank_statistics(positive.unionByName(zero), ["prototype"]).select(
        "prototype", "auc", "pval", "u"
    )
    total = F.col("n_case") + F.col("n_control")
    mean_case = F.try_divide(F.col("s_case"), F.col("n_case"))
    mean_control = F.try_divide(F.col("s_control"), F.col("n_control"))

    def safe(mean):
        return F.when(mean == 0, 1e-6).otherwise(mean)

    merged = base.join(tests, "prototype", "left").select(
        "prototype",
        (F.log2(safe(mean_case)) - F.log2(safe(mean_control))).alias("log_fc"),
        mean_case.alias("case_mean"),
        mean_control.alias("control_mean"),
        (F.col("nnz") / total).alias("expressed_frac"),
        (F.col("nnz") / total >= min_expressed).alias("tested"),
        "auc",
        "pval",
    )
    tested = R.adjust_fdr(merged.filter("tested"), out="fdr")
    skipped = merged.filter(~F.col("tested")).withColumn("fdr", F.lit(1.0)).withColumn(
        "pval", F.lit(1.0)
    ).withColumn("auc", F.lit(0.0))
    out = tested.unionByName(skipped)
    # untested prototypes keep auc 0 and effect size 0
    out = out.withColumn(
        "effect_size", F.when(F.col("tested"), F.abs(F.col("auc") - 0.5) * 2).otherwise(0.0)
    )
    strong = F.abs(F.col("auc") - 0.5) > 0.1
    return out.withColumn("significant", (F.col("fdr") < 0.05) & strong).withColumn(
        "direction", volcano_class(F.col("auc"), F.col("fdr"))
    ).withColumn("neg_log10_fdr", -F.log10(F.greatest(F.col("fdr"), F.lit(1e-300))))


def volcano_class(auc, fdr):
    return (
        F.when((auc > 0.6) & (fdr < 0.05), "up")
        .when((auc < 0.4) & (fdr < 0.05), "down")
        .otherwise("ns")
    )


def top_prototypes(markers: DataFrame, n: int = 25) -> DataFrame:
    """The n highest and n lowest AUCs, excluding degenerate ones."""
    valid = markers.filter((F.col("auc") > 0.01) & (F.col("auc") < 0.99))
    up = valid.filter(F.col("auc") > 0.5).orderBy(F.desc("auc"), "prototype").limit(n)
    down = valid.filter(F.col("auc") < 0.5).orderBy("auc", "prototype").limit(n)
    return up.withColumn("side", F.lit("case")).unionByName(
        down.withColumn("side", F.lit("control"))
    )
