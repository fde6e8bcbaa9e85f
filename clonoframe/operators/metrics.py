"""ROC, precision-recall and confusion metrics over prediction tables (label 0/1, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clonoframe.operators.running import running_totals


def score_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative true and false positives per distinct score, best score first."""
    by = list(by)
    hist = scored.groupBy(*by, "score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("pos"),
        F.sum((F.col("label") == 0).cast("long")).alias("neg"),
    )
    curve = running_totals(hist, by, "score", {"tp": "pos", "fp": "neg"}, descending=True)
    totals = hist.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    if by:
        return curve.join(totals, by)
    both = hist.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return curve.withColumn("_t", both).select(
        *curve.columns, F.col("_t.p").alias("p"), F.col("_t.n").alias("n")
    )


def roc_points(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    curve = score_curve(scored, by)
    return curve.select(
        *by,
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        F.try_divide(F.col("tp"), F.col("p")).alias("tpr"),
        F.try_divide(F.col("fp"), F.col("n")).alias("fpr"),
    )


def roc_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUC over tie-grouped scores, and the threshold with the best Youden index.

    Each score adds a trapezoid between the curve before and after it, which depends on
    its own counts only, so no neighbour lookup is needed.
    """
    curve = score_curve(scored, by)
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    youden = ratio(F.col("tp"), p) - ratio(F.col("fp"), n)
    best = F.max_by(
        F.struct(F.col("score").alias("threshold"), youden.alias("j"),
                 ratio(F.col("tp"), p).alias("sens"), (1 - ratio(F.col("fp"), n)).alias("spec")),
        F.struct(F.round(youden, 12), F.col("score")),
    )
    per = curve.groupBy(*by).agg(
        F.max("p").alias("p"), F.max("n").alias("n"), F.sum(area).alias("area"), best.alias("best")
    )
    fine = (F.col("p") > 0) & (F.col("n") > 0)
    return per.select(
        *by,
        F.when(fine, F.try_divide(F.col("area"), p * n)).otherwise(0.5).alias("auc"),
        F.when(fine, F.col("best.threshold")).alias("best_threshold"),
        F.when(fine, F.col("best.j")).alias("youden_j"),
        F.when(fine, F.col("best.sens")).alias("sensitivity"),
        F.when(fine, F.col("best.spec")).alias("specificity"),
    )


def pr_points(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    curve = score_curve(scored, by)
    return curve.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("p")).alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def pr_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two areas: average precision (steps) and the trapezoid from (0, 1).

    The precision before a score's block follows from the block's own counts, so both are
    sums over independent rows.
    """
    curve = score_curve(scored, by)
    tp, fp, p = (F.col(c).cast("double") for c in ("tp", "fp", "p"))
    here = ratio(tp, tp + fp)
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    before = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    gain = ratio(F.col("pos"), p)
    return curve.groupBy(*by).agg(
        F.sum(gain * here).alias("average_precision"),
        F.sum(gain * (here + before) / 2).alias("auc_pr"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_metrics(
    predicted: DataFrame, by: Sequence[str] = (), prediction: str = "prediction"
) -> DataFrame:
    """Confusion cells and the metrics derived from them, in one aggregation."""
    y, z = F.col("label") == 1, F.col(prediction) == 1

    def cell(flag: Column) -> Column:
        return F.sum(flag.cast("long"))

    cells = predicted.groupBy(*by).agg(
        cell(y & z).alias("tp"), cell(~y & z).alias("fp"),
        cell(y & ~z).alias("fn"), cell(~y & ~z).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    margin = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return cells.select(
        *by, "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp * tn - fp * fn, margin).alias("mcc"),
    )


def confusion(predicted: DataFrame, label="label", prediction="prediction") -> DataFrame:
    return predicted.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(predicted: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """Precision, recall, F1 per class, with accuracy and macro-F1 alongside."""
    cells = confusion(predicted, label, prediction)
    n, hit = F.col("n"), F.col(label) == F.col(prediction)
    truth = cells.groupBy(F.col(label).alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, n).otherwise(0)).alias("tp")
    )
    given = cells.groupBy(F.col(prediction).alias("class")).agg(F.sum("n").alias("called"))
    tp, support = F.col("tp").cast("double"), F.col("support").cast("double")
    called = F.coalesce(F.col("called"), F.lit(0)).cast("double")
    precision, recall = ratio(tp, called), ratio(tp, support)
    rows = truth.join(given, "class", "left").select(
        "class",
        "support",
        "tp",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * tp, support + called).alias("f1"),
    )
    # one row per class from here on
    everything = W.partitionBy()
    return rows.select(
        "class", "support", "precision", "recall", "f1",
        (F.sum("tp").over(everything) / F.sum("support").over(everything)).alias("accuracy"),
        F.avg("f1").over(everything).alias("macro_f1"),
    )
