"""Clone table derived from the star-schema test tables.

One clone record per line item, one sample per supplier; the receptor sequence and its
genes are functions of the part, so they are computed once per part before the join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoframe.session import spread

HEX_TO_RESIDUE = ("0123456789abcdef", "ASSLGQDTEYNRVPKI")


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def receptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and genes per part.

    They are derived from a generated copy of the key. Derived from the join key itself,
    every filter on a sequence would be inferred for the line items too, and the hashing
    repeated per line item.
    """
    key = F.col("_key")
    body = F.translate(F.md5(key.cast("string")), *HEX_TO_RESIDUE)
    tail = (
        F.when(key % 23 == 0, "*").when(key % 2 == 0, "F").when(key % 31 == 0, "A").otherwise("W")
    )
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", F.explode(F.array("p_partkey")).alias("_key")
    )
    return parts.select(
        "p_partkey",
        F.concat(F.lit("C"), F.substring(body, F.lit(1), (4 + key % 16).cast("int")), tail).alias(
            "cdr3_aa"
        ),
        F.concat(F.lit("TRBV"), F.col("p_size").cast("string")).alias("v_gene"),
        F.concat(
            F.lit("TRBJ"),
            (1 + key % 2).cast("string"),
            F.lit("-"),
            (1 + key % 7).cast("string"),
        ).alias("j_gene"),
        F.when(F.col("p_size") % 3 == 0, "TRA").otherwise("TRB").alias("chain"),
    )


@lru_cache(maxsize=8)
def clones(
    spark: SparkSession, sf_dir: str, describe: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Clone records; ``describe`` adds columns to the table of receptors, before the join."""
    found = receptors(spark, sf_dir)
    added = describe(found) if describe else found
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample_id"),
        F.when(F.col("s_nationkey") % 2 == 0, "control").otherwise("case").alias("group"),
        F.concat(F.lit("g"), (F.col("s_nationkey") % 4).cast("string")).alias("group4"),
    )
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return (
        lines.join(added, lines.l_partkey == F.col("p_partkey"))
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .select(
            "sample_id",
            "group",
            "cdr3_aa",
            "v_gene",
            "j_gene",
            "chain",
            F.col("l_orderkey").cast("string").alias("pair_id"),
            F.col("l_quantity").cast("long").alias("count"),
            F.col("l_partkey").cast("long").alias("receptor_key"),
            "group4",
            *[c for c in added.columns if c not in found.columns],
        )
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long"), "embedding", F.col("label").cast("int")
    )
