"""Benchmarks over labelled data sets, per sample and per sequence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoframe.functions.sequence import property_columns
from clonoframe.operators import benchfeatures, models
from clonoframe.schema import sample_meta


def benchmark_samples(
    name: str, clones: DataFrame, chain: str = "TRB", n_folds: int = 5, n_trees: int = 500,
    seed: int = 42, save_to: str | None = None,
) -> dict:
    """Benchmark features, cross-validated forest, category importance, final model."""
    table = benchfeatures.benchmark_features(clones, chain).join(
        sample_meta(clones).select("sample_id", "group"), "sample_id"
    )
    columns = [c for c in table.columns if c not in ("sample_id", "group")]
    return _benchmark(name, table, columns, n_folds, n_trees, seed, save_to, {"chain": chain})


def benchmark_sequences(
    name: str, rows: DataFrame, n_folds: int = 5, n_trees: int = 500, seed: int = 42,
    save_to: str | None = None,
) -> dict:
    """Per-sequence properties of labelled sequences (cdr3_aa, label)."""
    columns = property_columns()
    table = rows.select(
        F.col("cdr3_aa").alias("sample_id"),
        F.when(F.col("label") == 1, "positive").otherwise("background").alias("group"),
        *[c.cast("double").alias(n) for n, c in columns.items()],
    )
    return _benchmark(name, table, list(columns), n_folds, n_trees, seed, save_to, {})


def _benchmark(name, table, columns, n_folds, n_trees, seed, save_to, info) -> dict:
    rows, classes, used = models.prepare(table, columns)
    cv = models.cross_validate(rows, classes, used, "rf", n_folds, seed, n_trees=n_trees)
    summary = cv["pooled"].withColumn("dataset", F.lit(name)).withColumn(
        "n_features", F.lit(len(used))
    )
    if save_to:
        final = models.estimator("rf", len(classes), n_trees=n_trees, seed=seed).fit(rows)
        models.save_model(
            final, {"dataset": name, "features": used, **info, **summary.first().asDict()},
            rows.sparkSession, save_to,
        )
    return {
        "summary": summary,
        "importance": cv["importance"],
        "categories": models.category_importance(cv["importance"]),
        "predictions": cv["predictions"],
        "roc": cv["roc"],
    }


def run_benchmark(
    samples: dict[str, tuple[DataFrame, str]],
    sequences: dict[str, DataFrame] | None = None,
    **options,
) -> DataFrame:
    """One summary row per data set. ``samples`` maps a name to (clones, chain)."""
    parts = [
        benchmark_samples(name, clones, chain, **options)["summary"]
        for name, (clones, chain) in samples.items()
    ]
    parts += [
        benchmark_sequences(name, rows, **options)["summary"]
        for name, rows in (sequences or {}).items()
    ]
    return reduce(DataFrame.unionByName, parts)
