"""Running totals over an ordered column without putting a whole group into one task.

Input is a histogram: one row per (group, value) with additive columns. Spark sorts it by range,
so the number of ranges is that of the sort's partitions and grows with the data. The sorted
rows are checkpointed with their partition; partitions are totalled per group (a few rows each),
and the running total inside a partition starts from the total of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clonoframe.session import cut_lineage


def with_range(hist: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Sorted and checkpointed, with ``_range``: the ascending number of the row's value range.

    A sort by ranges reads its input twice, first for the bounds, so that is checkpointed as well.
    """
    return cut_lineage(cut_lineage(hist).orderBy(*by, value)).withColumn("_range", F.spark_partition_id())


def running_totals(
    hist: DataFrame,
    by: Sequence[str],
    value: str,
    totals: dict[str, str],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums in value order: ``totals`` maps output name to summed column."""
    by = list(by)
    single = not by
    if single:
        hist, by = hist.withColumn("_all", F.lit(1)), ["_all"]
    ranged = with_range(hist, by, value)
    blocks = ranged.groupBy(*by, "_range").agg(
        *[F.sum(source).alias(f"_block_{name}") for name, source in totals.items()]
    )

    def way(column: str) -> Column:
        return F.desc(column) if descending else F.asc(column)

    earlier = W.partitionBy(*by).orderBy(way("_range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(
        *by,
        "_range",
        *[F.sum(f"_block_{name}").over(earlier).alias(f"_before_{name}") for name in totals],
    )
    inside = (
        W.partitionBy(*by, "_range").orderBy(way(value)).rowsBetween(W.unboundedPreceding, 0)
    )
    out = ranged.join(offsets, [*by, "_range"])
    for name, source in totals.items():
        start = F.coalesce(F.col(f"_before_{name}"), F.lit(0))
        out = out.withColumn(name, start + F.sum(source).over(inside))
    out = out.drop("_range", *[f"_before_{name}" for name in totals])
    return out.drop("_all") if single else out


def running_minimum_from_top(hist: DataFrame, value: str, scored: str, out: str) -> DataFrame:
    """Minimum of ``scored`` over all rows whose value is at least this row's value."""
    ranged = with_range(hist.withColumn("_all", F.lit(1)), ["_all"], value)
    blocks = ranged.groupBy("_all", "_range").agg(F.min(scored).alias("_low"))
    later = W.partitionBy("_all").orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select("_all", "_range", F.min("_low").over(later).alias("_above"))
    inside = (
        W.partitionBy("_all", "_range")
        .orderBy(F.desc(value))
        .rowsBetween(W.unboundedPreceding, 0)
    )
    joined = ranged.join(offsets, ["_all", "_range"])
    return joined.withColumn(
        out, F.least(F.min(scored).over(inside), F.col("_above"))
    ).drop("_all", "_range", "_above")
