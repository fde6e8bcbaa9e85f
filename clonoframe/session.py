"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "clonoframe", cores: str | None = None, partitions: int | None = None):
    """A local session for tests and the bench; on a cluster pass your own session instead."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        # one shuffle partition per core already: merging them would idle cores
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "4g"))
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Used where one table feeds several branches of a plan: it is then computed once and
    survives lost executors. Only a local session without the setting gets a folder of its
    own.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints, set first where it is not."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, in Parquet: for tables of many rows, which a checkpoint would not compress."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core for a table too small to be split by its files.

    Scans split their input down to the open-cost size to occupy all cores; only a table
    below that size per core is redistributed by key. Anything larger pays no shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if size < cores * split else df


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions the session is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles_for(spark: SparkSession, rows: int, rows_per_task: int) -> Iterator[None]:
    """Inside, shuffles have enough partitions for that many rows, and never fewer than configured.

    For steps that make many more rows than they read; whatever depends on it must be
    checkpointed inside.
    """
    name, before = "spark.sql.shuffle.partitions", partitions(spark)
    spark.conf.set(name, str(max(before, -(-int(rows) // rows_per_task))))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, not when its plan is collected.

    For steps that shuffle many times what they keep; what is to be read again must be checkpointed,
    staged or persisted inside.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def packed(df: DataFrame, rows_per_task: int) -> DataFrame:
    """Checkpoint, then use as many partitions as the rows need.

    For tables that iterative algorithms scan many times: each scan's task count follows
    the measured row count, so small tables do not pay for empty tasks.
    """
    table = cut_lineage(df)
    return table.coalesce(max(1, -(-table.count() // rows_per_task)))
