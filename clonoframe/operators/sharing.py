"""Clonotype sharing between samples.

The summed overlap of a sample with all others equals the sum, over its clonotypes, of how
many other samples hold them, so mean overlaps are linear in the distinct (sample,
clonotype) rows and no sample pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def owned_clonotypes(clones: DataFrame) -> DataFrame:
    return clones.select("sample_id", "group", "cdr3_aa").distinct()


def with_presence(owned: DataFrame) -> DataFrame:
    """Add how many samples, and how many of the same group, hold each clonotype.

    A clonotype has at most one row per sample here, which bounds the window.
    """
    # dealt by clonotype and sorted by group inside: one shuffle and one sort serve both windows
    dealt = owned.repartition("cdr3_aa").sortWithinPartitions("cdr3_aa", "group")
    return dealt.withColumn("presence", F.count(F.lit(1)).over(W.partitionBy("cdr3_aa"))).withColumn(
        "in_group", F.count(F.lit(1)).over(W.partitionBy("cdr3_aa", "group"))
    )


def sharing_statistics(clones: DataFrame) -> DataFrame:
    """Per sample: distinct clonotypes, convergence, group convergence, private share."""
    owned = with_presence(owned_clonotypes(clones))
    samples = clones.select("sample_id", "group").distinct()
    sizes = samples.groupBy("group").agg(F.count(F.lit(1)).alias("_peers"))
    total = samples.agg(F.count(F.lit(1))).scalar()
    mates = F.coalesce(F.col("_peers"), F.lit(1)) - 1
    same, both = F.col("in_group"), F.col("presence")
    rows = owned.join(sizes, "group", "left").groupBy("sample_id").agg(
        F.max(F.col("group").isNotNull()).alias("known"),  # the greatest name itself would need all rows sorted
        F.max(mates).alias("mates"),
        F.max(F.lit(total)).alias("samples"),
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(both - 1).alias("shared"),
        F.sum(same - 1).alias("shared_in"),
        F.sum(both - same).alias("shared_out"),
        F.sum((both == 1).cast("long")).alias("private"),
        F.sum((both > mates * 0.5).cast("long")).alias("high"),
    )
    n, mates = F.col("n"), F.col("mates")
    others = F.col("samples") - 1
    foreign = others - mates
    known = F.col("known")
    intra = F.when(known & (mates > 0), F.try_divide(F.col("shared_in"), n * mates)).otherwise(0.0)
    inter = F.when(known & (foreign > 0), F.try_divide(F.col("shared_out"), n * foreign)).otherwise(0.0)
    return rows.select(
        "sample_id",
        n.cast("long").alias("n_distinct"),
        F.when(others > 0, F.try_divide(F.col("shared"), n * others)).otherwise(0.0).alias("convergence_idx"),
        intra.alias("intra_group_convergence"),
        inter.alias("inter_group_convergence"),
        F.when(inter > 0, F.try_divide(intra, inter)).alias("convergence_ratio"),
        (F.col("private") / n).alias("private_clone_ratio"),
        F.when(known & (mates > 0), F.col("high") / n).alias("high_share_clone_ratio"),
    )


def overlap_with(clones: DataFrame, anchors: DataFrame) -> DataFrame:
    """|A and B| / |A| of every sample A with each anchor sample B.

    ``anchors`` is a one-column table of sample ids chosen by the caller; the result has one
    row per sample and anchor that occurs in ``clones``, with 0 where nothing is shared. Those
    zeros come from one list of anchors per sample, so the work grows with the result.
    """
    owned = clones.select("sample_id", "cdr3_aa").distinct()
    theirs = owned.join(anchors.select("sample_id"), "sample_id", "left_semi").select(
        F.col("sample_id").alias("anchor_id"), "cdr3_aa"
    )
    sizes = owned.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    shared = owned.join(theirs, "cdr3_aa").groupBy("sample_id", "anchor_id").agg(
        F.count(F.lit(1)).alias("shared")
    )
    chosen = theirs.agg(F.collect_set("anchor_id")).scalar()
    wanted = sizes.select("sample_id", "n", F.explode(chosen).alias("anchor_id"))
    common = F.coalesce("shared", F.lit(0))
    return wanted.join(shared, ["sample_id", "anchor_id"], "left").select(
        "sample_id", "anchor_id", common.alias("shared"), (common / F.col("n")).alias("overlap")
    )


def public_clonotypes(
    clones: DataFrame, min_patient_frac: float = 0.2, strict: bool = False
) -> DataFrame:
    """Clonotypes held by at least a fraction of a group's samples (all of them if strict).

    The most widely held come first.
    """
    owned = owned_clonotypes(clones.filter(F.col("group").isNotNull()))
    sizes = (
        clones.filter(F.col("group").isNotNull())
        .select("group", "sample_id")
        .distinct()
        .groupBy("group")
        .agg(F.count(F.lit(1)).alias("n_samples"))
        .filter(F.col("n_samples") >= 2)
    )
    held = owned.groupBy("group", "cdr3_aa").agg(F.count(F.lit(1)).alias("held_by"))
    frac = F.col("held_by") / F.col("n_samples")
    rows = held.join(sizes, "group").select(
        "cdr3_aa", "group", "held_by", frac.alias("patient_frac")
    )
    floor = 1.0 if strict else min_patient_frac
    public = rows.filter(F.col("patient_frac") >= floor)
    return public.orderBy(F.desc("patient_frac"), "group", "cdr3_aa")
