"""Reference pools, antigen tables and sequence lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoframe.functions.sequence import standard_only
from clonoframe.operators.sampling import sample_per_group
from clonoframe.sources.clones import separator

MIN_POOL_LENGTH = 8


def pool_rows(rows: DataFrame, seq_col: str, count_col: str | None = None) -> DataFrame:
    """Clean (sequence, count): trimmed, valid, counts at least 1; empty without the column."""
    if seq_col not in rows.columns:
        return rows.sparkSession.createDataFrame([], "sequence string, count long")
    count = F.lit(1)
    if count_col and count_col in rows.columns:
        count = F.greatest(F.coalesce(F.col(count_col).try_cast("double"), F.lit(1)), F.lit(1))
    cleaned = rows.select(
        F.trim(F.col(seq_col)).alias("sequence"), count.cast("long").alias("count")
    )
    return cleaned.filter(standard_only("sequence", MIN_POOL_LENGTH))


def read_pool(
    spark: SparkSession, path: str | Sequence[str], seq_col: str, count_col: str | None = None
) -> DataFrame:
    """csv, tsv or txt files, compressed or not; all columns as text, cast where used.

    Each path is read with the separator of its own extension.
    """
    by_sep: dict[str, list[str]] = {}
    for one in [path] if isinstance(path, str) else path:
        by_sep.setdefault(separator(one), []).append(one)
    parts = [
        pool_rows(spark.read.csv(paths, header=True, sep=sep), seq_col, count_col)
        for sep, paths in by_sep.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def build_pool(datasets: Sequence[DataFrame], top: int | None = None) -> DataFrame:
    """Distinct sequence to total count over all datasets, optionally the largest ``top``."""
    cleaned = [pool_rows(d, "sequence", "count") for d in datasets]
    pool = reduce(DataFrame.unionByName, cleaned).groupBy("sequence").agg(
        F.sum("count").cast("long").alias("total_count")
    )
    return pool if top is None else pool.orderBy(F.desc("total_count"), "sequence").limit(top)


def unique_sequences(clones: DataFrame, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Distinct standard sequences; with ``limit`` a hash-ordered sample of so many."""
    distinct = clones.select("cdr3_aa").filter(standard_only("cdr3_aa")).distinct()
    if limit is None:
        return distinct
    return sample_per_group(distinct, [], limit, ["cdr3_aa"], seed)


def chain_sequences(clones: DataFrame, chain: str = "single") -> DataFrame:
    """Distinct sequences of the chains a projection uses."""
    wanted = {"single": ["TRB"], "paired": ["TRA", "TRB"]}.get(
        chain, ["TRA", "TRB", "TRG", "TRD", "IGH", "IGK", "IGL"]
    )
    return clones.filter(F.col("chain").isin(wanted)).select("cdr3_aa").distinct()


def antigen_dataset(
    positives: DataFrame, background: DataFrame, n_per_group: int | None = None, seed: int = 42
) -> DataFrame:
    """Labelled sequences of both classes, genes kept with their sequence.

    ``n_per_group`` draws a seeded sample of so many per class, for balanced benchmarks.
    """
    sides = []
    for rows, label in ((positives, 1), (background, 0)):
        genes = [
            F.coalesce(F.col(g), F.lit("?")).alias(g) if g in rows.columns else F.lit("?").alias(g)
            for g in ("v_gene", "j_gene")
        ]
        valid = rows.filter(standard_only("cdr3_aa", 4)).select("cdr3_aa", *genes).distinct()
        if n_per_group is not None:
            valid = sample_per_group(valid, [], n_per_group, ["cdr3_aa", "v_gene", "j_gene"], seed)
        sides.append(
            valid.withColumn("count", F.lit(1).cast("long")).withColumn(
                "label", F.lit(label)
            )
        )
    return sides[0].unionByName(sides[1])


ANTIGEN_COLUMNS = {
    "cdr3": "cdr3_aa", "v": "v_gene", "j": "j_gene", "gene": "gene", "species": "species",
    "mhc.a": "mhc_a", "mhc.b": "mhc_b", "epitope": "epitope", "antigen.species": "antigen_species",
}


def read_antigen_export(
    spark: SparkSession,
    path: str,
    species: str | None = None,
    gene: str | None = None,
    limit: int | None = None,
    score: str = "vdjdb.score",
) -> DataFrame:
    """Nine columns of an antigen-database export; with ``limit`` the best scores only."""
    rows = spark.read.csv(path, header=True, sep="\t", quote="")
    if species:
        rows = rows.filter(F.col("species") == species)
    if gene:
        rows = rows.filter(F.col("gene") == gene)
    if limit is not None:
        known = [F.desc(F.col(f"`{score}`").try_cast("double"))] if score in rows.columns else []
        rows = rows.orderBy(*known, F.col("cdr3")).limit(limit)
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in ANTIGEN_COLUMNS.items()])


def read_map_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Map metadata from the first of three file names that exists."""
    names = ["ref_metadata.csv", "ref_metadata.csv.gz", "refmap_metadata_augmented.csv"]
    path_class = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for name in names:
        target = path_class(f"{folder}/{name}")
        if target.getFileSystem(conf).exists(target):
            return spark.read.csv(f"{folder}/{name}", header=True, inferSchema=True)
    raise FileNotFoundError(f"no map metadata in {folder}")
