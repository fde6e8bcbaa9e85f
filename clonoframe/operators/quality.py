"""Quality control, chain selection and read normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoframe import schema as S
from clonoframe.functions.sequence import col
from clonoframe.operators import sampling


def passes_qc(
    seq: str | Column = "cdr3_aa",
    min_len: int = 6,
    max_len: int = 30,
    enforce_framework: bool = True,
) -> Column:
    """No stop codon, standard residues only, length in range, optional C...F/W frame."""
    seq = col(seq)
    ok = seq.rlike(f"^[{S.RESIDUES}]+$") & F.length(seq).between(min_len, max_len)
    return ok & seq.rlike("^C.*[FW]$") if enforce_framework else ok


def quality_filter(clones: DataFrame, **limits) -> DataFrame:
    return clones.filter(passes_qc(**limits))


def quality_summary(clones: DataFrame, **limits) -> DataFrame:
    """Rows kept and removed, and the reads that remain, in one aggregation."""
    keep = F.coalesce(passes_qc(**limits), F.lit(False))
    return clones.agg(
        F.sum(keep.cast("long")).alias("kept"),
        F.sum((~keep).cast("long")).alias("removed"),
        F.sum(F.when(keep, F.col("count")).otherwise(0)).alias("reads_kept"),
    )


def reads_per_sample(clones: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Reads per sample; with ``meta``, samples left without clones get zero."""
    reads = clones.groupBy("sample_id").agg(F.sum("count").cast("long").alias("reads"))
    if meta is None:
        return reads
    return (
        meta.drop("reads")
        .join(reads, "sample_id", "left")
        .withColumn("reads", F.coalesce("reads", F.lit(0)))
    )


def with_frequency(clones: DataFrame, key: str = "sample_id") -> DataFrame:
    """freq = count / total reads of the sample.

    The totals are aggregated first and joined back, so a sample's rows are never
    gathered: the small side is broadcast when its measured size allows, and a skewed
    sort-merge join is split by the adaptive planner otherwise.
    """
    totals = clones.groupBy(key).agg(F.sum("count").cast("double").alias("_reads"))
    shares = clones.drop("freq").join(totals, key)
    return shares.withColumn("freq", F.try_divide(F.col("count"), F.col("_reads"))).drop("_reads")


def chain_counts(clones: DataFrame) -> DataFrame:
    return clones.groupBy("chain").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "chain"
    )


def resolve_chains(clones: DataFrame, chain: str = "single") -> list[str]:
    """Chains to analyse: most frequent, pair, all, an explicit ``A+B`` list, or one name."""
    found = [row["chain"] for row in chain_counts(clones).collect()]
    if not found:
        return []
    both = [c for c in ("TRA", "TRB") if c in found]
    if chain == "single":
        return found[:1]
    if chain == "all":
        return found
    if chain == "paired":
        return both if len(both) == 2 else found
    if "+" in chain:
        named = [c.strip() for c in chain.split("+")]
        return named if all(c in found for c in named) else found
    return [chain] if chain in found else found[:1]


def select_chains(clones: DataFrame, chain: str = "single") -> DataFrame:
    return clones.filter(F.col("chain").isin(resolve_chains(clones, chain)))


def main_chain(clones: DataFrame) -> DataFrame:
    """Rows of the most frequent chain, resolved inside the query plan."""
    top = chain_counts(clones).limit(1).select("chain")
    return clones.join(F.broadcast(top), "chain", "left_semi")


def rarefy(clones: DataFrame, target_reads: int = 1000, seed: int = 0) -> DataFrame:
    """Draw ``target_reads`` reads per sample without replacement.

    Samples below the target are dropped; records drawn zero times stay with count 0.
    Identical records are one record. Every read has a number hashed from its record, and the
    least numbers of a sample are drawn (``sampling.draw_copies``), the same way whatever its size.
    """
    fields = [c for c in clones.columns if c not in ("count", "freq")]
    merged = clones.groupBy(*fields).agg(F.sum("count").cast("long").alias("count"))
    # the reads of a sample need no merged records
    sizes = clones.groupBy("sample_id").agg(F.sum("count").cast("long").alias("_all"))
    large = sizes.where(F.col("_all") >= target_reads)
    drawn = sampling.draw_copies(merged, ["sample_id"], "count", target_reads, fields, seed, large)
    # records without a drawn read stay, with count 0
    zero = merged.join(large.select("sample_id"), "sample_id").select(*fields, F.lit(0).cast("long").alias("drawn"))
    both = drawn.select(*fields, "drawn").unionAll(zero).groupBy(*fields).agg(F.sum("drawn").alias("count"))
    return both.withColumn("freq", F.col("count") / F.lit(float(target_reads)))
