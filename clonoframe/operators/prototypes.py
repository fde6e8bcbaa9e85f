"""Prototype panels: assignment of sequence vectors, count tables, annotation, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoframe.functions.sequence import explode_kmers

PANEL_BYTES = 512 * 1024 * 1024
SCORED = 1 << 22  # scores of rows against centroids held at a time, 32 MB


def mean_centroids(vectors: DataFrame, label: str = "label", column: str = "embedding") -> DataFrame:
    """One centroid per label: the mean vector, summed inside the executors."""
    doubles = F.col(column).cast("array<double>")
    return (
        vectors.select(F.col(label).alias("prototype"), array_to_vector(doubles).alias("_v"))
        .groupBy("prototype")
        .agg(Summarizer.mean(F.col("_v")).alias("_m"))
        .select("prototype", vector_to_array("_m").alias("centroid"))
    )


def panel_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Panel as (ids, matrix). Its size is m x dimensions, set by the panel, and is checked."""
    shape = centroids.agg(
        F.count(F.lit(1)).alias("m"), F.max(F.size("centroid")).alias("d")
    ).first()
    if shape["m"] * (shape["d"] or 0) * 8 > PANEL_BYTES:
        raise ValueError(f"panel of {shape['m']} x {shape['d']} does not fit one broadcast")
    rows = centroids.select("prototype", "centroid").orderBy("prototype").collect()
    ids = np.array([r["prototype"] for r in rows], dtype=np.int64)
    return ids, np.array([r["centroid"] for r in rows], dtype=np.float64)


class CentroidIndex:
    """Exact nearest-centroid search: centroids in groups, far groups left out by distance.

    About sqrt(m) groups around pivot centroids, each with its radius. By the triangle
    inequality no member of a group is nearer to a row than the distance to the pivot less the
    radius; groups are visited per block of rows in order of that bound, and a row leaves once
    it exceeds its best distance. Scores are made for SCORED cells at a time, so a worker holds
    the panel and 3 * SCORED doubles, whatever the number of centroids and rows. Ties go to the
    first centroid, as in a full search.
    """

    def __init__(self, matrix: np.ndarray):
        # about a common origin, so that rounding is relative to the spread and not to an offset
        self.origin = matrix.mean(axis=0)
        centred = matrix - self.origin
        self.squares = np.einsum("ij,ij->i", centred, centred)
        m = len(matrix)
        many = max(1, int(np.sqrt(m)))
        self.pivots = centred[np.linspace(0, m - 1, many).astype(int)]
        pivot_squares = np.einsum("ij,ij->i", self.pivots, self.pivots)
        group = np.empty(m, np.int64)
        for at in range(0, m, max(1, SCORED // many)):
            part = slice(at, at + max(1, SCORED // many))
            group[part] = np.argmin(pivot_squares - 2 * centred[part] @ self.pivots.T, axis=1)
        self.pivot_squares = pivot_squares
        self.members = [np.flatnonzero(group == g) for g in range(many)]
        self.blocks = [centred[own] for own in self.members]
        self.radius = np.array([
            np.sqrt(((block - pivot) ** 2).sum(axis=1).max()) if len(block) else -np.inf
            for block, pivot in zip(self.blocks, self.pivots)
        ])
        self.scored = 0  # cells scored, for tests and tuning

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        """Position of the nearest centroid of every row."""
        out = np.empty(len(rows), np.int64)
        widest = max(len(self.pivots), max(map(len, self.members)))
        step = max(1, SCORED // widest)
        for at in range(0, len(rows), step):
            out[at : at + step] = self._nearest(rows[at : at + step] - self.origin)
        return out

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        own = np.einsum("ij,ij->i", x, x)
        to_pivot = np.sqrt(np.maximum(own[:, None] - 2 * x @ self.pivots.T + self.pivot_squares, 0))
        self.scored += to_pivot.size
        # squares are computed with rounding, so bounds are loosened by more than that
        slack = 1e-6 * (np.sqrt(own) + np.sqrt(self.squares.max()))
        bound = to_pivot - self.radius - slack[:, None]
        best = np.full(len(x), np.inf)
        place = np.zeros(len(x), np.int64)
        # each row's own group first, then the groups that some row cannot rule out
        first = bound.argmin(axis=1)
        for mine in (True, False):
            for g, members in enumerate(self.members):
                near = (first == g) if mine else (first != g) & (bound[:, g] <= np.sqrt(np.maximum(best, 0)))
                rows = np.flatnonzero(near)
                if not len(rows) or not len(members):
                    continue
                square = own[rows, None] - 2 * x[rows] @ self.blocks[g].T + self.squares[members]
                self.scored += square.size
                at = square.argmin(axis=1)
                found, where = square[np.arange(len(rows)), at], members[at]
                better = (found < best[rows]) | ((found == best[rows]) & (where < place[rows]))
                best[rows[better]], place[rows[better]] = found[better], where[better]
        return place


def _largest_products(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    step = max(1, SCORED // len(matrix))
    parts = [np.argmax(rows[at : at + step] @ matrix.T, axis=1) for at in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def assign_nearest(
    vectors: DataFrame, centroids: DataFrame, column: str = "embedding", metric: str = "euclidean"
) -> DataFrame:
    """Add ``prototype``: nearest centroid, or largest dot product with ``metric='dot'``.

    Exact for any panel that passes the size check; see ``CentroidIndex`` for the memory held.
    Without centroids it is null; a row with NaN gets the first centroid.
    """
    if metric not in ("euclidean", "dot"):
        raise ValueError(f"unknown metric {metric}")
    ids, matrix = panel_matrix(centroids)
    if not len(ids):
        return vectors.withColumn("prototype", F.lit(None).cast("long"))
    index = CentroidIndex(matrix) if metric == "euclidean" else matrix
    panel = vectors.sparkSession.sparkContext.broadcast((ids, index))

    @F.pandas_udf(T.LongType())
    def nearest(batch: pd.Series) -> pd.Series:
        ids, index = panel.value
        x = np.stack(batch.to_numpy()).astype(np.float64)
        at = index.nearest(x) if metric == "euclidean" else _largest_products(x, index)
        return pd.Series(ids[at])

    return vectors.withColumn("prototype", nearest(F.col(column)))


def sample_prototype_counts(clones: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """Reads per (sample, prototype), non-zero cells only.

    Clones are summed per (sample, key) before the join, so a hot sequence is one row per
    sample by the time it meets its assignment.
    """
    per = clones.groupBy("sample_id", key).agg(F.sum("count").alias("count"))
    return (
        per.join(assignments.select(key, "prototype"), key)
        .groupBy("sample_id", "prototype")
        .agg(F.sum("count").cast("long").alias("count"))
    )


def sparsity(counts: DataFrame, n_samples: Column | int, n_prototypes: Column | int) -> DataFrame:
    cells = F.lit(n_samples) * F.lit(n_prototypes)
    return counts.agg(
        F.count(F.lit(1)).alias("nonzero"), (1 - F.count(F.lit(1)) / cells).alias("sparsity")
    )


def cluster_sizes(assignments: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Members per prototype, empty ones included."""
    sizes = assignments.groupBy("prototype").agg(F.count(F.lit(1)).alias("members"))
    return prototypes.select("prototype").join(sizes, "prototype", "left").na.fill(0, ["members"])


def cluster_size_summary(sizes: DataFrame) -> DataFrame:
    return sizes.agg(
        F.min("members").alias("smallest"),
        F.max("members").alias("largest"),
        F.percentile("members", 0.5).alias("median"),
    )


def _row_scaled(counts: DataFrame, total: Column, name: str) -> DataFrame:
    totals = counts.groupBy("sample_id").agg(total.alias("_total"))
    value = F.coalesce(F.try_divide(F.col("count"), F.col("_total")), F.lit(0.0))
    return counts.join(totals, "sample_id").select(
        "sample_id", "prototype", "count", value.alias(name)
    )


def l2_rows(counts: DataFrame) -> DataFrame:
    c = F.col("count").cast("double")
    return _row_scaled(counts, F.sqrt(F.sum(c * c)), "l2")


def frequency_rows(counts: DataFrame) -> DataFrame:
    return _row_scaled(counts, F.sum(F.col("count").cast("double")), "freq")


def sample_vectors(rows: DataFrame, value: str, keys: str = "prototype") -> DataFrame:
    """(sample_id, keys, values): at most one entry per prototype, so arrays stay panel-sized."""
    packed = rows.groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col(keys).alias("k"), F.col(value).alias("v")))).alias("p")
    )
    return packed.select(
        "sample_id",
        F.transform("p", lambda s: s["k"]).alias("keys"),
        F.transform("p", lambda s: s["v"].cast("double")).alias("values"),
    )


# ---- interpretation ---------------------------------------------------------------


def log_enrichment(n1: Column, n0: Column, t1: Column, t0: Column, epsilon: float) -> Column:
    f1, f0 = n1 / (t1 + 1), n0 / (t0 + 1)
    return F.log2((f1 + epsilon) / (f0 + epsilon))


def gene_enrichment(
    clones: DataFrame, assignments: DataFrame, key: str, case_set: Column, control_set: Column,
    gene: str = "v_gene", cap: int = 10,
) -> DataFrame:
    """Gene use of two prototype sets; each occurrence weighs at most ``cap`` reads."""
    weighted = clones.groupBy(key, gene).agg(
        F.sum(F.least(F.col("count"), F.lit(cap))).alias("w")
    )
    rows = weighted.join(assignments.select(key, "prototype"), key).groupBy(
        F.col(gene).alias("gene")
    ).agg(
        F.sum(F.when(case_set, F.col("w")).otherwise(0)).alias("case_count"),
        F.sum(F.when(control_set, F.col("w")).otherwise(0)).alias("control_count"),
    )
    return _enriched(rows.filter((F.col("case_count") > 0) | (F.col("control_count") > 0)), 1e-6)


def _enriched(rows: DataFrame, epsilon: float) -> DataFrame:
    total = rows.agg(
        F.struct(F.sum("case_count").alias("a"), F.sum("control_count").alias("b"))
    ).scalar()
    scored = rows.withColumn("_t", total)
    value = log_enrichment(
        F.col("case_count"), F.col("control_count"), F.col("_t.a"), F.col("_t.b"), epsilon
    )
    return scored.withColumn("log2_enrichment", value).drop("_t")


def kmer_enrichment(
    sequences: DataFrame, case_set: Column, control_set: Column, k: int = 4, min_count: int = 5
) -> DataFrame:
    """k-mer use of two prototype sets over (cdr3_aa, prototype) rows."""
    rows = (
        explode_kmers(sequences, k, "prototype", name="motif")
        .groupBy("motif")
        .agg(
            F.sum(case_set.cast("long")).alias("case_count"),
            F.sum(control_set.cast("long")).alias("control_count"),
        )
    )
    return _enriched(rows, 1e-8).filter(F.col("case_count") >= min_count)


def prototype_convergence(clones: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """Distinct V-J pairs per sequence and distinct V genes of each prototype."""
    genes = clones.select(key, "v_gene", "j_gene").distinct()
    members = assignments.groupBy("prototype").agg(F.count(F.lit(1)).alias("n_seqs"))
    pairs = genes.join(assignments.select(key, "prototype"), key).select(
        "prototype", "v_gene", "j_gene"
    ).distinct()
    by_v = pairs.groupBy("prototype", "v_gene").agg(F.count(F.lit(1)).alias("j"))
    per = by_v.groupBy("prototype").agg(
        F.sum("j").alias("n_vj_pairs"), F.count(F.lit(1)).alias("n_v_genes")
    )
    score = F.col("n_vj_pairs") / F.greatest(F.col("n_seqs"), F.lit(1))
    return members.join(per, "prototype", "left").na.fill(0).withColumn("convergence_score", score)


def known_matches(sequences: DataFrame, known: DataFrame, column: str = "cdr3_aa") -> DataFrame:
    """Distinct sequences per prototype and how many are in a known-specificity list."""
    distinct = sequences.select("prototype", column).distinct()
    listed = known.select(column).distinct().withColumn("_hit", F.lit(1))
    return (
        distinct.join(listed, column, "left")
        .groupBy("prototype")
        .agg(F.count(F.lit(1)).alias("n_seqs"), F.count("_hit").alias("n_matches"))
        .withColumn("match_rate", F.col("n_matches") / F.col("n_seqs"))
    )


def _top_names(rows: DataFrame, gene: str, n: int) -> DataFrame:
    counts = rows.groupBy("prototype", gene).agg(F.count(F.lit(1)).alias("c"))
    spot = W.partitionBy("prototype").orderBy(F.desc("c"), gene)
    best = counts.withColumn("_r", F.row_number().over(spot)).filter(F.col("_r") <= n)
    return best.groupBy("prototype").agg(
        F.concat_ws(
            ",", F.transform(F.sort_array(F.collect_list(F.struct("_r", gene))), lambda s: s[gene])
        ).alias(f"top_{gene}")
    )


def annotate_prototypes(
    sequences: DataFrame, n_genes: int = 3, n_examples: int = 5
) -> DataFrame:
    """Per prototype: distinct sequences, mean length, top genes, example sequences.

    ``sequences`` is (prototype, cdr3_aa, v_gene, j_gene). Examples are the first n in
    sequence order.
    """
    distinct = sequences.select("prototype", "cdr3_aa", "v_gene", "j_gene").distinct()
    seqs = distinct.select("prototype", "cdr3_aa").distinct()
    base = seqs.groupBy("prototype").agg(
        F.count(F.lit(1)).alias("n_seqs"), F.avg(F.length("cdr3_aa")).alias("mean_length")
    )
    spot = W.partitionBy("prototype").orderBy("cdr3_aa")
    shown = (
        seqs.withColumn("_r", F.row_number().over(spot))
        .filter(F.col("_r") <= n_examples)
        .groupBy("prototype")
        .agg(F.concat_ws(",", F.sort_array(F.collect_list("cdr3_aa"))).alias("examples"))
    )
    out = base.join(shown, "prototype")
    for gene in ("v_gene", "j_gene"):
        out = out.join(_top_names(distinct, gene, n_genes), "prototype")
    return out


def weight_ranking(weights: DataFrame) -> DataFrame:
    """Fold coefficients (fold, prototype, weight) to mean, spread, t, rank and shares.

    One row per prototype of the panel, so the ranking window is panel-sized.
    """
    per = weights.groupBy("prototype").agg(
        F.avg("weight").alias("mean_weight"), F.stddev_pop("weight").alias("sd_weight")
    )
    size = F.abs("mean_weight")
    spot = W.orderBy(F.desc("importance"), "prototype")
    return (
        per.withColumn("importance", size)
        .withColumn("t", F.col("mean_weight") / (F.col("sd_weight") + 1e-10))
        .withColumn("rank", F.row_number().over(spot))
        .withColumn(
            "cumulative_share",
            F.try_divide(
                F.sum("importance").over(spot.rowsBetween(W.unboundedPreceding, 0)),
                F.sum("importance").over(W.partitionBy()),
            ),
        )
    )


def ranks_to_reach(ranking: DataFrame, shares: Sequence[float] = (0.5, 0.8, 0.9)) -> DataFrame:
    return ranking.agg(
        *[
            F.min(F.when(F.col("cumulative_share") >= s, F.col("rank"))).alias(f"n_{int(s * 100)}")
            for s in shares
        ]
    )


def signed_extremes(ranking: DataFrame, n: int = 100) -> DataFrame:
    """The n weights of largest size, by the side their sign speaks for."""
    top = ranking.orderBy(F.desc(F.abs("mean_weight")), "prototype").limit(n)
    return top.withColumn("side", F.when(F.col("mean_weight") > 0, "case").otherwise("control"))
