"""Sequence panels: pool, train, project, classify and interpret."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoframe.operators import (
    clusters,
    domains,
    maps,
    models,
    panels,
    prototypes,
    ranktests,
    reduction,
)
from clonoframe.functions.sequence import profile_columns
from clonoframe.session import cut_lineage, packed
from clonoframe.sources.pools import build_pool


def train_from_pool(
    datasets: Sequence[DataFrame], m: int, model=None, seed: int = 42, **embedding
) -> dict:
    """Pool the datasets, embed the distinct sequences, train the panel."""
    pool = build_pool(datasets)
    vectors = cut_lineage(maps.embed_sequences(pool, model=model, **embedding))
    kmeans, info = panels.train_panel(panels.as_vectors(vectors), m, seed)
    centroids = panels.panel_centroids(kmeans, pool.sparkSession)
    return {"pool": pool, "vectors": vectors, "model": kmeans, "info": info, "centroids": centroids}


def project_samples(clones: DataFrame, centroids: DataFrame, model=None, **embedding):
    """(assignments, counts): every distinct sequence is embedded and assigned once."""
    sequences = clones.select(F.col("cdr3_aa").alias("sequence"))
    vectors = maps.embed_sequences(sequences, model=model, **embedding)
    assigned = prototypes.assign_nearest(vectors, centroids).select(
        F.col("sequence").alias("cdr3_aa"), "prototype"
    )
    assigned = cut_lineage(assigned)
    return assigned, prototypes.sample_prototype_counts(clones, assigned, "cdr3_aa")


def labelled_vectors(counts: DataFrame, labels: DataFrame, value: str = "l2") -> DataFrame:
    """Sparse sample rows (keys, values) joined with (sample_id, group, label)."""
    scaled = prototypes.l2_rows(counts) if value == "l2" else prototypes.frequency_rows(counts)
    return packed(prototypes.sample_vectors(scaled, value).join(labels, "sample_id"), 2_000)


def model_rows(vectors: DataFrame, ids: Sequence[int]) -> DataFrame:
    """ML vectors for the classifiers, entries in panel order, filled in Arrow batches."""
    place = {int(p): i for i, p in enumerate(ids)}

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dense = np.zeros((len(pdf), len(place)))
            for r, (keys, values) in enumerate(zip(pdf["keys"], pdf["values"])):
                dense[r, [place[k] for k in keys]] = values
            yield pdf.drop(columns=["keys", "values"]).assign(dense=list(dense))

    kept = [f for f in vectors.schema.fields if f.name not in ("keys", "values")]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    ordered = vectors.select(*[f.name for f in kept], "keys", "values")
    rows = ordered.mapInPandas(fill, f"{shape}, dense array<double>")
    return rows.withColumns(
        {"x": array_to_vector("dense"), "class": F.col("group"), "subject_id": F.col("sample_id")}
    ).drop("dense")


def classify_samples(
    vectors: DataFrame, ids: Sequence[int], method: str = "svm", n_folds: int = 5, seed: int = 42,
    **options,
) -> dict:
    """Cross-validated linear SVM (or another classifier) on prototype rows."""
    rows = model_rows(vectors, ids).select("sample_id", "subject_id", "class", "label", "x")
    rows = rows.withColumn("label", F.col("label").cast("double"))
    return models.cross_validate(
        rows, ["control", "case"], [str(p) for p in ids], method, n_folds, seed, **options
    )


def unified_analysis(
    counts: DataFrame, labels: DataFrame, ids: Sequence[int], n_components: int = 50,
    dims: int = 30, seed: int = 42,
) -> dict:
    """PCA, cluster choice, SVM and logistic scores, cluster annotation of sample rows."""
    vectors = labelled_vectors(counts, labels)
    scores, share, cumulative = reduction.prototype_components(vectors, ids, n_components)
    scores = cut_lineage(scores)
    table, best = panels.scan_clusters(scores, "label", dims=dims, seed=seed)
    svm = classify_samples(vectors, ids, "svm", seed=seed)
    logistic = classify_samples(vectors, ids, "ridge", seed=seed)
    weights = svm["weights"].select(
        "fold", F.col("feature").cast("long").alias("prototype"), "weight"
    )
    return {
        "scores": scores,
        "explained": share,
        "cumulative": cumulative,
        "clusters": table,
        "composition": clusters.composition(best),
        "svm": svm,
        "logistic": logistic,
        "weights": prototypes.weight_ranking(weights),
    }


def supervised_views(vectors: DataFrame, ids: Sequence[int], svm_weights: np.ndarray, bias: float,
                     dims: int = 30) -> dict[str, DataFrame]:
    """Disease axis with its orthogonal component, PLS and LDA coordinates."""
    scores, _, _ = reduction.prototype_components(vectors, ids, dims)
    return {
        "axis": reduction.disease_axis(vectors, ids, svm_weights, bias),
        "pls": reduction.pls_scores(vectors, ids),
        "lda": reduction.discriminant_scores(cut_lineage(scores)),
    }


def interpret(
    clones: DataFrame,
    assignments: DataFrame,
    ranking: DataFrame,
    known: DataFrame | None = None,
    key: str = "cdr3_aa",
    n_top: int = 100,
    k: int = 4,
) -> dict[str, DataFrame]:
    """What the most positive and most negative prototypes consist of."""
    extremes = cut_lineage(prototypes.signed_extremes(ranking, n_top).select("prototype", "side"))
    top = assignments.select(key, "prototype").join(extremes, "prototype")
    case, control = F.col("side") == "case", F.col("side") == "control"
    genes = {}
    tagged = top.withColumn("prototype", F.when(case, 1).otherwise(0))
    for gene in ("v_gene", "j_gene"):
        genes[f"{gene}_enrichment"] = prototypes.gene_enrichment(
            clones, tagged, key, F.col("prototype") == 1, F.col("prototype") == 0, gene
        )
    per_sequence = clones.select(*{key, "cdr3_aa", "v_gene", "j_gene"}).distinct().join(top, key)
    sequences = per_sequence.select("prototype", "side", "cdr3_aa").distinct()
    sided = sequences.select(F.when(case, 1).otherwise(0).alias("prototype"), "cdr3_aa")
    profile = sequences.select("side", *[c.alias(n) for n, c in profile_columns().items()])
    out = {
        **genes,
        "kmer_enrichment": prototypes.kmer_enrichment(
            sided, F.col("prototype") == 1, F.col("prototype") == 0, k
        ),
        "physchem": domains.property_comparison(
            profile, ["length", "charge", "hydrophobicity", "aromaticity", "glycine", "proline"],
            control,
        ),
        "convergence": prototypes.prototype_convergence(clones, top, key),
        "annotation": prototypes.annotate_prototypes(per_sequence),
        "reach": prototypes.ranks_to_reach(ranking),
    }
    if known is not None:
        out["known"] = prototypes.known_matches(sequences, known)
    return out


def end_rows(table: DataFrame, by: str, name: str, n: int = 15) -> DataFrame:
    """The n highest and n lowest rows of an enrichment table; ``name`` decides ties."""
    top = table.orderBy(F.desc(by), name).limit(n).withColumn("end", F.lit("top"))
    return top.unionByName(
        table.orderBy(F.asc(by), name).limit(n).withColumn("end", F.lit("bottom"))
    )


def adjusted_properties(comparison: DataFrame) -> DataFrame:
    return ranktests.adjust_fdr(comparison)
