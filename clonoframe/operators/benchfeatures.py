"""The benchmark feature set: read-weighted properties, diversity, gene shares, V-J mass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clonoframe import schema as S
from clonoframe.functions import sequence as Q
from clonoframe.operators import spectrum
from clonoframe.operators.features import gene_statistics, gene_table

PHYS = ["len", "charge", "hydro", "arom"]
VJ = ["vj_n_unique_pairs", "vj_pair_entropy", "vj_pair_simpson", "vj_max_pair_frac",
      "vj_v_entropy", "vj_v_simpson", "vj_j_entropy", "vj_j_simpson", "vj_n_v_genes",
      "vj_n_j_genes", "vj_pair_ratio"]


def floored(clones: DataFrame) -> DataFrame:
    return clones.withColumn("count", F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)))


def physical(clones: DataFrame) -> DataFrame:
    """Read-weighted means and unweighted population deviations of four properties."""
    rows = floored(clones).select(
        "sample_id",
        F.col("count").cast("double").alias("w"),
        F.length("cdr3_aa").alias("len"),
        Q.net_charge("cdr3_aa").alias("charge"),
        Q.hydropathy("cdr3_aa", unknown_as_zero=True).alias("hydro"),
        Q.aromatic_fraction("cdr3_aa").alias("arom"),
    )
    aggs: list[Column] = []
    for p in PHYS:
        aggs.append((F.sum(F.col("w") * F.col(p)) / F.sum("w")).alias(f"phys_{p}_mean"))
        aggs.append(F.stddev_pop(p).alias(f"phys_{p}_std"))
    return rows.groupBy("sample_id").agg(*aggs)


def diversity(clones: DataFrame) -> DataFrame:
    clones = floored(clones)
    stats = spectrum.spectrum_statistics(spectrum.count_spectrum(clones))
    unique = clones.select("sample_id", "cdr3_aa").distinct().groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("_unique")
    )
    n = F.col("n").cast("double")
    many = F.col("n") > 1
    return stats.join(unique, "sample_id").select(
        "sample_id",
        F.col("simpson").alias("div_simpson"),
        F.col("shannon").alias("div_shannon"),
        F.when(many, 1 - F.try_divide(F.col("shannon"), F.ln(n))).otherwise(0.0).alias("div_clonality"),
        (F.col("d50_index") / n).alias("div_d50"),
        F.when(many, F.try_divide(F.col("shannon"), F.ln(n))).otherwise(0.0).alias("div_pielou"),
        F.col("n").alias("div_n_clones"),
        F.col("top_clone_frac").alias("conv_top1_freq"),
        F.col("top5_freq").alias("conv_top5_freq"),
        (F.col("_unique") / n).alias("conv_unique_ratio"),
    )


def gene_shares(clones: DataFrame, chain: str = "TRB", vocab: dict | None = None) -> DataFrame:
    """Share of a sample's rows per vocabulary gene, from the bounded gene table."""
    vocab = vocab or S.GENE_VOCAB.get(chain, S.GENE_VOCAB["TRB"])
    total = F.sum("mass")
    rows = gene_table(clones.drop("duplicate_count"))
    columns = [
        (F.sum(F.when(F.col(c) == g, F.col("mass")).otherwise(0.0)) / total).alias(f"{p}_{g}")
        for c, p, names in (("v_gene", "vgene", vocab["V"]), ("j_gene", "jgene", vocab["J"]))
        for g in names
    ]
    return rows.groupBy("sample_id").agg(*columns)


def benchmark_features(clones: DataFrame, chain: str = "TRB") -> DataFrame:
    out = physical(clones)
    for frame in (
        diversity(clones),
        gene_shares(clones, chain),
        gene_statistics(floored(clones), "count").select("sample_id", *VJ),
    ):
        out = out.join(frame, "sample_id")
    return out


def top_clones(
    clones: DataFrame, n: int = 500, by: Sequence[str] = ("sample_id",), tie: str = "cdr3_aa"
) -> DataFrame:
    """Largest n records per sample.

    A ranked filter keeps at most n rows per sample in every map task, so a huge sample
    reaches its reduce task already trimmed. Beyond the planner's per-group limit the
    trimming is done explicitly over salted sub-groups first.
    """
    rest = [F.col(c).asc_nulls_last() for c in sorted(set(clones.columns) - {"count", tie, *by})]
    order = [F.desc("count"), F.col(tie), *rest]
    limit = int(clones.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        salt = F.pmod(F.xxhash64(*clones.columns), F.lit(256))
        inner = W.partitionBy(*by, "_salt").orderBy(*order)
        clones = (
            clones.withColumn("_salt", salt)
            .withColumn("_rank", F.row_number().over(inner))
            .filter(F.col("_rank") <= n)
            .drop("_rank", "_salt")
        )
    ranked = clones.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")
