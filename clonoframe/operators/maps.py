"""Sequence vectors, and two-dimensional maps of sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoframe.functions.sequence import domain_classes, kmers, map_columns


def embed_sequences(
    sequences: DataFrame,
    column: str = "sequence",
    model: Callable[[list[str]], np.ndarray] | None = None,
    dimensions: int = 64,
    k: int = 3,
    batch: int = 256,
) -> DataFrame:
    """Vector per distinct sequence.

    ``model`` maps a list of sequences to a matrix (for example a loaded language model
    with masked mean pooling) and runs in executor batches; without one, the vector is the
    mean of hashed k-mer indicators, built from JVM operators only. Null and empty
    sequences are dropped.
    """
    distinct = sequences.select(column).filter(F.length(column) > 0).distinct()
    if model is None:
        words = distinct.withColumn("_w", kmers(column, k))
        hashed = HashingTF(numFeatures=dimensions, inputCol="_w", outputCol="_h").transform(words)
        n = F.greatest(F.size("_w"), F.lit(1))
        return hashed.select(
            column, F.transform(vector_to_array("_h"), lambda x: x / n).alias("embedding")
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                yield part.assign(embedding=list(np.asarray(model(part[column].tolist()), float)))

    return distinct.mapInPandas(run, f"{column} string, embedding array<double>")


def project(vectors: DataFrame, layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Coordinates from fixed affine layers with ReLU between them (weights are given)."""
    shared = vectors.sparkSession.sparkContext.broadcast(
        [(np.asarray(w, float), np.asarray(b, float)) for w, b in layers]
    )

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def forward(batch: pd.Series) -> pd.Series:
        x = np.stack(batch.to_numpy()).astype(float)
        for i, (w, b) in enumerate(shared.value):
            x = x @ w + b
            if i + 1 < len(shared.value):
                x = np.maximum(x, 0)
        return pd.Series(list(x))

    placed = vectors.withColumn("_xy", forward("embedding"))
    return placed.withColumn("x", F.col("_xy")[0]).withColumn("y", F.col("_xy")[1]).drop("_xy")


def fitted_coordinates(vectors: DataFrame) -> DataFrame:
    """First two principal coordinates of all rows: one distributed Gramian, then one pass."""
    rows = vectors.withColumn("_v", array_to_vector("embedding"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(2)])
    xy = vector_to_array("_p")
    return model.transform(rows).select(
        *vectors.columns, (xy[0] * float(signs[0])).alias("x"), (xy[1] * float(signs[1])).alias("y")
    )


def annotate_map(rows: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Add length, charge, hydropathy, aromatic share (3 dp) and the four classes."""
    base = rows.select("*", *[c.alias(n) for n, c in map_columns(sequence).items()])
    classes = domain_classes(
        F.col("length"), F.col("net_charge"), F.col("hydrophobicity"), F.col("aromatic_frac")
    )
    return base.select("*", *[c.alias(n) for n, c in classes.items()])


def build_map(
    clones: DataFrame,
    layers: Sequence[tuple[np.ndarray, np.ndarray]] | None = None,
    model: Callable | None = None,
    **embedding,
) -> DataFrame:
    """Distinct (chain, sequence) rows with coordinates and properties."""
    by_chain = clones.select("chain", F.col("cdr3_aa").alias("sequence")).distinct()
    vectors = embed_sequences(by_chain, model=model, **embedding)
    placed = project(vectors, layers) if layers is not None else fitted_coordinates(vectors)
    rows = by_chain.join(placed.drop("embedding"), "sequence")
    return annotate_map(rows).select(
        "sequence", "chain", "length", "net_charge", "hydrophobicity", "aromatic_frac", "x", "y",
        "length_class", "charge_class", "hydro_class", "aromatic_class",
    )


def map_summary(rows: DataFrame) -> DataFrame:
    """Size and coordinate ranges per chain and overall."""
    def ranges(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            *[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))],
        )

    return ranges(rows, "chain").unionByName(
        ranges(rows).withColumn("chain", F.lit("all")).select("chain", "n", "x_min", "x_max", "y_min", "y_max")
    )


def project_clones(clones: DataFrame, layers, model=None, **embedding) -> DataFrame:
    """Score new sequences on a fixed map; each distinct sequence once."""
    sequences = clones.select(F.col("cdr3_aa").alias("sequence"))
    return annotate_map(project(embed_sequences(sequences, model=model, **embedding), layers)).drop("embedding")


def coordinate_table(rows: DataFrame) -> DataFrame:
    """Coordinates at six decimals for export."""
    return rows.select(
        F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "chain", "sequence"
    )
