"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoframe.session import cut_lineage

#: ASCII white space, as the word pattern of this subpackage excludes it.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            cut_lineage(spark.range(1))  # a local session gets a folder of its own
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"


#: Lets Spark drop a finished write's shuffle files at once, instead of at some later collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, folder: str) -> None:
    """Write Parquet, then free the shuffle files that led to it."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        conf.set(CLEANUP, before)


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, lost executors lose nothing."""
    folder = shared_folder(df.sparkSession)
    write(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: A key is hot when it holds more than this share of the rows; so there are at most as many.
HOT_SHARE = 64


def joined_evenly(big: DataFrame, small: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``big`` with one row per key, where a few keys may hold most of the rows.

    ``small`` says in ``count`` how many rows of ``big`` a key has. Fewer than ``HOT_SHARE`` keys can
    exceed their share; those are broadcast, so their rows stay where they are, and only the
    others are shuffled. Both sides should be staged, as they are read twice.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > total
    some, rest = small.where(hot).drop(count), small.where(~hot).drop(count)
    cold = big.join(F.broadcast(some.select(*keys)), keys, "left_anti")
    return big.join(F.broadcast(some), keys).unionByName(cold.join(rest, keys))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``position`` (0-based rank) by a distributed sort, without a global window.

    Rows are range-sorted and staged with their partition and offset; only one count per
    partition reaches the driver.
    """
    spark = df.sparkSession
    rows = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33)
    counts = sorted(
        (r["part"], r["count"]) for r in rows.groupBy(part.alias("part")).count().collect()
    )
    starts, total = [], 0
    for number, count in counts:
        starts.append((number, total))
        total += count
    start = spark.createDataFrame(starts, "_part long, _start long")
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(start), "_part")
        .withColumn("position", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1))
        .drop("_id", "_part", "_start")
    )


def id_ranges(df: DataFrame, parts: int, column: str = "doc_id") -> Column:
    """Number (0 to parts - 1) of the id range a row belongs to, in ascending order of ids.

    The bounds are approximate quantiles of the ids alone (parts - 1 numbers), so no wide row is
    read for them; a null id belongs to the first range.
    """
    marks = [(i + 1) / parts for i in range(parts - 1)]
    found = df.select(F.percentile_approx(column, marks, 10_000).alias("q")).first()["q"] if marks else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(b) for b in bounds])
    below = F.filter(edges, lambda e: e < F.col(column))
    return F.when(F.col(column).isNull(), 0).otherwise(F.size(below))


#: Stands for a null id inside tasks, where a null would turn a column of longs into doubles.
NO_ID = -(1 << 63)


def held_id(column: Column | str = "doc_id") -> Column:
    """The id as a long without nulls; it sorts as the null did, before all others."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def freed_id(column: Column | str = "doc_id") -> Column:
    """The id that ``held_id`` held."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(column, F.lit(NO_ID))
