"""From clone table to classifier and analysis tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoframe import schema as S
from clonoframe.operators import domains, features, maps, markers, models, quality

FEATURE_SETS = {
    "basic": list(features.BASIC_MODULES),
    "enhanced": list(features.ENHANCED_MODULES),
    "all": [*features.BASIC_MODULES, *features.ENHANCED_MODULES],
}


def sample_table(
    clones: DataFrame,
    chain: str = "single",
    feature_set: str = "enhanced",
    meta: DataFrame | None = None,
    qc: dict | None = None,
    **options,
) -> tuple[DataFrame, list[str], list[str]]:
    """Chain choice, quality filter and features: (table, feature columns, chains)."""
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set '{feature_set}'")
    chains = quality.resolve_chains(clones, chain)
    kept = quality.quality_filter(clones.filter(F.col("chain").isin(chains)), **(qc or {}))
    meta = S.sample_meta(kept) if meta is None else meta
    modules = FEATURE_SETS[feature_set]
    if len(chains) == 1:
        table = features.compute_features(kept, meta, modules, **options)
    else:
        wide = features.multi_chain_features(kept, chains, modules, **options)
        table = meta.select("sample_id", "group").join(wide, "sample_id")
    columns = [c for c in table.columns if c not in ("sample_id", "group")]
    return table, columns, chains


def run_tier1(
    clones: DataFrame,
    chain: str = "single",
    feature_set: str = "enhanced",
    classifier: str = "rf",
    n_folds: int = 5,
    subject: DataFrame | None = None,
    seed: int = 42,
    model_options: dict | None = None,
    **options,
) -> dict:
    """Features per sample, then cross-validation of the requested classifier.

    ``subject`` (sample_id, subject_id) keeps several samples of one person in one fold.
    """
    table, columns, chains = sample_table(clones, chain, feature_set, **options)
    if subject is not None:
        table = table.join(subject, "sample_id", "left").withColumn(
            "subject_id", F.coalesce("subject_id", "sample_id")
        )
    rows, classes, used = models.prepare(
        table, columns, subject="subject_id" if subject is not None else None
    )
    cv = models.cross_validate(
        rows, classes, used, classifier, n_folds, seed, **(model_options or {})
    )
    return {
        "chains": ",".join(chains),
        "features": table,
        "feature_columns": used,
        "cv_results": models.fold_summary(cv["folds"]),
        "cv_details": cv["folds"],
        "feature_importance": cv["importance"].orderBy(F.desc("importance"), "feature"),
        "predictions": cv["predictions"],
        **{k: cv[k] for k in ("pooled", "roc", "fold_roc") if k in cv},
    }


def domain_analysis(
    rows: DataFrame,
    axes: Sequence[str] = ("x", "y"),
    case: str = "case",
    control: str = "control",
    motifs: Sequence[str] = ("QDFA",),
    families: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Significance, expansion, axis and redistribution tables of annotated sequence rows."""
    properties = ["net_charge", "hydrophobicity", "aromatic_frac", "length"]
    return {
        "domain_significance": domains.domain_significance(rows, case, control),
        "expansion": domains.expansion_gradient(rows, "count", case, control),
        "axis_decoding": domains.axis_correlation(rows, list(axes), properties),
        "sequence_scores": domains.axis_auc(rows, list(axes), case),
        "centroid_shift": domains.centroid_shift(rows, axes[-1], case, control),
        "redistribution": domains.frequency_redistribution(rows, case, control),
        "v_families": domains.family_shares(rows, families, case, control),
        "motifs": domains.motif_by_group(rows, list(motifs), case, control),
    }


def run_complete(
    clones: DataFrame,
    layers=None,
    classify: bool = True,
    project: bool = True,
    analyse: bool = True,
    mark: bool = True,
    case: str = "case",
    control: str = "control",
    **tier1,
) -> dict:
    """Classification, projection of the clones, and analysis of the projected rows."""
    out: dict = {}
    if classify:
        out.update(run_tier1(clones, **tier1))
    if mark:
        kept = quality.quality_filter(clones)
        out["sequence_markers"] = markers.sequence_markers(kept)
        if "features" in out:
            out["statistical_markers"] = markers.statistical_markers(
                out["features"], out["feature_columns"]
            )
    if project:
        kept = quality.quality_filter(clones)
        placed = maps.build_map(kept, layers)
        out["projection"] = placed
        if analyse:
            coords = placed.select(F.col("sequence").alias("cdr3_aa"), "chain", "x", "y")
            rows = domains.sequence_map(kept.join(coords, ["cdr3_aa", "chain"]))
            out.update(domain_analysis(rows, ("x", "y"), case, control))
    return out
