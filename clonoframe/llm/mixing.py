"""Mixing sources to target weights by Pareto order sampling.

Targets: every source gets its weight's share of the wanted total, but no more than ``cap``
times its size; the excess is reshared by weight until no target is above. Each pass is one
aggregate over the sources; only a few sums reach the driver.

Selection: a source whose target is r times its size takes every document floor(r) times for
certain. The rest is a sample of fixed size in words: documents are ranked by

    (u / (1 - u)) / (p / (1 - p)),

u being uniform by a hash of the id and p the document's inclusion probability (the fraction of
r), and taken in that order until the missing words are reached. The rank is turned into
[0, 1) and counted by source and bucket, so the cut is found from counts; only the documents of
the one bucket it falls into are ordered, never a whole source.

Defined cases: null text has size 0; null sources form one source, ordered last; documents of
size 0 are taken 0 or more times without effect; rows with the same id are taken alike; a null
id is a value of its own; reruns agree since nothing is random but the hash; columns of any
name pass through ``mixed`` unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoframe.llm.shared import ranked, staged

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKETS = 1 << 14
SEED = "mix-1"


def size(text: Column) -> Column:
    """Number of words, runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, share: float = 1.0
) -> DataFrame:
    """(source, source_size) with ``target``; weights repeat over the sources in order."""
    turns = F.array(*[F.lit(int(w)) for w in weights])
    order = ranked(sources, F.col("source").asc_nulls_last())
    rows = staged(
        order.select(
            "source", "source_size",
            F.get(turns, (F.col("position") % len(weights)).cast("int")).alias("weight"),
            (F.col("source_size") * cap).cast("decimal(38,0)").alias("limit"),
        )
    )
    full, weight, count = rows.agg(
        F.sum("source_size"), F.sum("weight"), F.count("*")
    ).first()
    if not count:
        return rows.select("source", "source_size", F.lit(0.0).alias("target"))
    total = rest = int(round(full * share))
    capped = 0
    while True:
        # compared in whole numbers: weight * rest / weights > limit
        over = F.col("weight").cast("decimal(38,0)") * F.lit(str(rest)).cast("decimal(20,0)") > (
            F.col("limit") * F.lit(str(weight)).cast("decimal(18,0)")
        )
        if not weight:
            over = F.lit(True)
            break
        now, held, used = rows.agg(
            F.count_if(over), F.sum(F.when(over, F.col("limit"))), F.sum(F.when(over, F.col("weight")))
        ).first()
        if now == capped:
            break
        capped, rest = now, total - int(held or 0)
        weight = rows.agg(F.sum("weight")).first()[0] - int(used or 0)
    spread = F.col("weight").cast("double") * float(rest) / float(max(1, weight))
    return rows.select(
        "source", "source_size",
        F.when(over, F.col("limit").cast("double")).otherwise(spread).alias("target"),
    )


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """52 bits of the id's md5 as a number strictly between 0 and 1."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    number = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (number + 0.5) / float(1 << 52)


def _rank(doc_id: Column, chance: Column) -> Column:
    """The Pareto rank q as q / (1 + q); null where nothing is to be sampled."""
    u = uniform(doc_id)
    q = (u / (1 - u)) / (chance / (1 - chance))
    return F.when(chance > 0, q / (1 + q))


def _bucket(rank: Column) -> Column:
    return F.least(F.floor(rank * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def cuts(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole copies, inclusion chance, and the rank where its sample ends.

    ``sized`` has doc_id, source and size of every document; ``goals`` is from ``targets``.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = goals.select(
        F.col("source").alias("src"), "source_size", "target",
        F.floor(ratio).cast("int").alias("whole"),
        (ratio - F.floor(ratio)).alias("chance"),
        (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("missing"),
    )
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("src"))).select(
        "src", "size", "missing", _id(F.col("doc_id")).alias("id"),
        _rank(F.col("doc_id"), F.col("chance")).alias("rank"),
    ).where("rank is not null")
    rows = rows.withColumn("bucket", _bucket(F.col("rank")))
    counted = rows.groupBy("src", "bucket").agg(
        F.sum("size").alias("words"), F.first("missing").alias("missing")
    )
    upto = F.sum("words").over(Window.partitionBy("src").orderBy("bucket"))
    edge = (
        counted.withColumn("before", upto - F.col("words"))
        .where("before < missing and before + words >= missing")
        .groupBy("src")
        .agg(F.min(F.struct("bucket", "before")).alias("e"))
        .select(F.col("src").alias("edge_src"), "e.*")
    )
    near = rows.join(
        edge,
        F.col("src").eqNullSafe(F.col("edge_src")) & (rows["bucket"] == edge["bucket"]),
    ).select("src", "size", "missing", "id", "rank", "before")
    within = Window.partitionBy("src").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, -1)
    sofar = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    last = (
        near.withColumn("fits", sofar + F.col("size") / 2 <= F.col("missing"))
        .where("fits")
        .groupBy(F.col("src").alias("last_src"))
        .agg(F.max(F.struct("rank", "id")).alias("last"))
    )
    return (
        plan.join(edge, F.col("src").eqNullSafe(F.col("edge_src")), "left")
        .join(last, F.col("src").eqNullSafe(F.col("last_src")), "left")
        .select("src", "source_size", "target", "whole", "chance", "bucket", "last")
    )


def copies(doc_id: Column, plan: str = "plan") -> Column:
    """Times a document is taken, in a row holding its source's ``cuts`` as struct ``plan``."""
    part = {c: F.col(f"{plan}.{c}") for c in ("whole", "chance", "bucket", "last")}
    rank = _rank(doc_id, part["chance"])
    here = F.struct(rank.alias("rank"), _id(doc_id).alias("id"))
    inside = (_bucket(rank) < part["bucket"]) | (
        (_bucket(rank) == part["bucket"]) & (here <= part["last"])
    )
    return part["whole"] + F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)


def sizes(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, source and size of every document, staged."""
    return staged(docs.select("doc_id", "source", size(F.col("text")).alias("size")))


def planned(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The ``cuts`` of sized documents, staged: one row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = staged(targets(totals, weights, cap))
    return staged(cuts(sized, goals))


def _planned_rows(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan as struct ``_plan``; one row per source on the other side."""
    wrapped = plan.select(F.struct(*plan.columns).alias("_plan"))
    return docs.join(wrapped, docs["source"].eqNullSafe(F.col("_plan.src")))


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per document: size, source_size, target of its source, and words taken."""
    sized = sizes(docs)
    taken = copies(F.col("doc_id"), "_plan") * F.col("size")
    return _planned_rows(sized, planned(sized, weights, cap)).select(
        "doc_id", "source", "size", "_plan.source_size", "_plan.target",
        taken.cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, columns unchanged.

    The texts are read twice and joined with one row per source, never shuffled by id.
    """
    rows = _planned_rows(docs, planned(sizes(docs), weights, cap))
    times = copies(docs["doc_id"], "_plan")
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
