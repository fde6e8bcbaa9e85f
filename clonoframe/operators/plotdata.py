"""Tables behind the figures; nothing is drawn here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clonoframe.operators.features import resolve_columns


def labelled_coordinates(coords: DataFrame, x: str, y: str, group: str = "group"):
    """Labelled points and the mean point of every group."""
    points = coords.filter(F.col(group).isNotNull()).select("sample_id", group, x, y)
    return points, points.groupBy(group).agg(F.avg(x).alias(x), F.avg(y).alias(y))


def feature_on_coordinates(
    coords: DataFrame, features: DataFrame, name: str, x: str, y: str
) -> DataFrame:
    """Coordinates with a feature (or the mean of a module) and its median as midpoint."""
    chosen = resolve_columns(name, features.columns)
    value = sum((F.col(c) for c in chosen), F.lit(0.0)) / len(chosen)
    rows = coords.select("sample_id", x, y).join(
        features.select("sample_id", value.alias("value")), "sample_id"
    )
    return rows.withColumn("midpoint", rows.agg(F.median("value")).scalar())


def value_by_group(features: DataFrame, name: str, group: str = "group") -> DataFrame:
    """Five-number summary of a feature per group."""
    chosen = resolve_columns(name, features.columns)
    value = sum((F.col(c) for c in chosen), F.lit(0.0)) / len(chosen)
    cuts = F.percentile(value, [0.0, 0.25, 0.5, 0.75, 1.0])
    per = features.filter(F.col(group).isNotNull()).groupBy(group).agg(cuts.alias("q"))
    names = ["low", "q1", "median", "q3", "high"]
    return per.select(group, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def top_attributions(attributions: DataFrame, n: int = 15) -> DataFrame:
    return attributions.orderBy(F.desc(F.abs("attribution")), "feature").limit(n)


def top_motifs(sequence_markers: DataFrame, n: int = 10, group: str = "group") -> DataFrame:
    """Most enriched motifs of each group, with -log10 of the adjusted p."""
    spot = W.partitionBy(group).orderBy(F.desc("odds_ratio"), "motif")
    return (
        sequence_markers.filter(F.col("odds_ratio") > 1)
        .withColumn("rank", F.row_number().over(spot))
        .filter(F.col("rank") <= n)
        .withColumn("neg_log10_padj", -F.log10(F.greatest(F.col("padj"), F.lit(1e-300))))
    )


def z_scored_long(
    features: DataFrame, columns: Sequence[str], population: bool = False, epsilon: float = 0.0
) -> DataFrame:
    """(sample_id, group, feature, z); constant features give 0."""
    spread = F.stddev_pop if population else F.stddev_samp
    stats = features.agg(
        F.struct(
            *[F.struct(F.avg(c).alias("m"), spread(c).alias("s")).alias(c) for c in columns]
        )
    ).scalar()
    rows = features.withColumn("_stats", stats)

    def z(c: str):
        s = F.col(f"_stats.{c}.s") + epsilon
        return F.coalesce(F.try_divide(F.col(c) - F.col(f"_stats.{c}.m"), s), F.lit(0.0)).alias(c)

    scaled = rows.select("sample_id", "group", *[z(c) for c in columns])
    return scaled.unpivot(["sample_id", "group"], list(columns), "feature", "z")


def marker_heatmap(features: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Marker columns z-scored with the population deviation."""
    return z_scored_long(features, markers, population=True, epsilon=1e-10)


def gene_dots(sequences: DataFrame, min_prototypes: int = 2, n: int = 15) -> DataFrame:
    """Share of each V gene inside marker prototypes, for genes seen in several of them."""
    counts = sequences.groupBy("prototype", "v_gene").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("prototype").agg(F.sum("n").alias("total"))
    kept = (
        counts.groupBy("v_gene").agg(F.count(F.lit(1)).alias("in_prototypes"))
        .filter(F.col("in_prototypes") >= min_prototypes)
        .orderBy("v_gene")
        .limit(n)
    )
    return counts.join(kept, "v_gene").join(totals, "prototype").select(
        "prototype", "v_gene", "n", (F.col("n") / F.col("total")).alias("share")
    )


def roc_overlay(folds: DataFrame, pooled: DataFrame) -> DataFrame:
    """Per-fold and pooled ROC points in one table."""
    return folds.withColumn("curve", F.concat(F.lit("fold "), F.col("fold").cast("string"))).drop(
        "fold"
    ).unionByName(pooled.withColumn("curve", F.lit("pooled")))


def map_overlay(background: DataFrame, projected: DataFrame, fraction: float, seed: int = 42):
    """Hash-sampled background points below the projected ones."""
    from clonoframe.operators.sampling import sample_fraction

    thin = sample_fraction(background, fraction, ["sequence"], seed)
    columns = ["sequence", "x", "y"]
    return thin.select(*columns, F.lit("background").alias("layer")).unionByName(
        projected.select(*columns, F.lit("projected").alias("layer"))
    )
