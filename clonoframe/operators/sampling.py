"""Repeatable samples chosen by hashed keys: the k rows with the smallest hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clonoframe.operators.running import running_totals

HASH_SPAN = 2.0**63


def unit_hash(*parts: Column | str, seed: int) -> Column:
    """A repeatable number in [0, 1) from the row's own values."""
    return F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 1) / F.lit(HASH_SPAN)


def keep_share(k: int, rows: Column) -> Column:
    """Share of hashes worth keeping so that fewer than k survivors is out of the question.

    Keeps k + 30 sqrt(k) + 500 rows in expectation; the chance of a shortfall is below
    1e-100. Everything is kept when the group is not larger than that.
    """
    target = k + 30 * math.sqrt(k) + 500
    return F.least(F.lit(1.0), F.lit(target) / rows)


def sample_per_group(
    df: DataFrame, by: Sequence[str], k: int, identity: Sequence[str], seed: int = 42
) -> DataFrame:
    """k rows per group without replacement (all rows of smaller groups).

    A hash threshold from the group size trims map-side, so the ranking sees about k rows
    per group whatever the group holds.
    """
    by = list(by)
    single = not by
    if single:
        df, by = df.withColumn("_all", F.lit(1)), ["_all"]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    drawn = (
        df.withColumn("_u", unit_hash(*identity, seed=seed))
        .join(sizes, by)
        .filter(F.col("_u") < keep_share(k, F.col("_rows")))
    )
    spot = W.partitionBy(*by).orderBy("_u", *identity)
    out = drawn.withColumn("_rank", F.row_number().over(spot)).filter(F.col("_rank") <= k)
    return out.drop("_u", "_rows", "_rank", *(["_all"] if single else []))


def sample_fraction(df: DataFrame, fraction: float, identity: Sequence[str], seed: int = 42):
    """Nested samples: a smaller fraction is always a subset of a larger one."""
    return df.filter(unit_hash(*identity, seed=seed) < fraction)


#: Numbers that order copies are whole and below this, so other engines can repeat them.
SPAN = 1 << 52
#: Copies of one record numbered in one row.
COPIES = 4096


def record_key(identity: Sequence[str], seed: int) -> Column:
    """The text a record's numbers are hashed from; nulls are empty."""
    return F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])


def _hex(start: int, of: str) -> str:
    return f"cast(conv(substr({of}, {start}, 13), 16, 10) as bigint)"


def _copies(df: DataFrame, count: str) -> DataFrame:
    """One row per copy of a record, numbered from 0 in ``_copy``; at most ``COPIES`` are held at a time.

    Copies are made and hashed inside code generation, and only those that pass a filter become rows.
    """
    blocks = df.withColumn("_block", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {COPIES})")))
    ends = f"sequence(_block * {COPIES}, least({count} - 1, _block * {COPIES} + {COPIES - 1}))"
    return blocks.withColumn("_copy", F.explode(F.expr(ends))).drop("_block")


def draw_copies(
    df: DataFrame, by: Sequence[str], count: str, k: int, identity: Sequence[str], seed: int,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """How many of a record's ``count`` copies are among the k least-numbered of their group.

    A draw without replacement: each copy's number is the md5 of record and copy. Copies are
    numbered where their record stands, and all but about k per group are dropped at once by a
    threshold from the group's size, so neither copies nor a group are ever gathered. Records
    without a drawn copy are left out; ``identity`` names a record and holds ``by``. ``sizes`` (by,
    _all) may give the groups' copies, or fewer, where they are cheaper to have; groups not in it
    are left out.
    """
    positive = df.where(F.col(count) > 0).withColumn("_key", record_key(identity, seed))
    if sizes is None:
        sizes = positive.groupBy(*by).agg(F.sum(count).alias("_all"))
    share = keep_share(k, F.col("_all"))
    # hex digits of fixed length are ordered as their numbers, and "g" is above all of them
    bound = F.when(share >= 1, "g").otherwise(F.lower(F.lpad(F.hex((share * SPAN).cast("long")), 13, "0")))
    placed = _copies(positive.join(sizes.select(*by, bound.alias("_bound")), list(by)), count)
    hashed = placed.select(*identity, "_key", "_copy", "_bound", F.expr("substr(md5(concat_ws('|', _key, _copy)), 1, 13)").alias("_u"))
    # dealt by group before the ranking, else Spark would sort them on both sides of the shuffle
    alive = hashed.where("_u < _bound").select(*identity, "_copy", "_u").repartition(*by)
    alive = alive.withColumn("_key", record_key(identity, seed))
    order = W.partitionBy(*by).orderBy("_u", "_key", "_copy")
    drawn = alive.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return drawn.groupBy(*identity).agg(F.count(F.lit(1)).alias("drawn"))


def pseudo_samples(
    pool: DataFrame,
    n_samples: int = 50,
    per_sample: int = 500,
    seed: int = 42,
    identity: Sequence[str] = ("cdr3_aa", "v_gene"),
) -> DataFrame:
    """Draw ``per_sample`` pool rows per group, ``n_samples`` times.

    Rows carry ``group``. Each copy of a pool row has two md5 numbers h1, h2; its place in draw r
    is (h1 + r h2) mod ``SPAN``, and a draw takes the least places. Places are made inside code
    generation and only those that pass a threshold from the group's size become rows, so the pool is
    read and hashed once and about n_samples x per_sample rows per group are shuffled.
    """
    # copies of a pool row are separate draws: number them without gathering the pool
    counted = pool.groupBy("group", *identity).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_key", record_key(["group", *identity], seed))
    sizes = counted.groupBy("group").agg(F.sum("_n").alias("_rows"))
    limit = (keep_share(per_sample, F.col("_rows")) * SPAN).cast("long").alias("_limit")
    copies = _copies(counted.join(sizes.select("group", limit), "group"), "_n").withColumn(
        "_md5", F.md5(F.concat_ws("|", "_key", F.col("_copy").cast("string")))
    )
    numbered = copies.select(
        "group", *identity, "_key", "_copy", "_limit", F.expr(_hex(1, "_md5")).alias("_h1"), F.expr(_hex(14, "_md5")).alias("_h2")
    )
    places = numbered.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).select(
        "group", *identity, "_key", "_copy", "draw", "_limit", F.expr(f"(_h1 + draw * _h2) % {SPAN}L").alias("_u")
    )
    rows = places.where("_u < _limit").drop("_limit")
    spot = W.partitionBy("group", "draw").orderBy("_u", "_key", "_copy")
    kept = rows.withColumn("_rank", F.row_number().over(spot)).filter(
        F.col("_rank") <= per_sample
    )
    return kept.select(
        F.concat_ws("_", "group", "draw").alias("sample_id"),
        "group",
        *identity,
        F.lit("?").alias("j_gene"),
        F.lit("TRB").alias("chain"),
        F.lit(1).cast("long").alias("count"),
    )


def stratified_folds(
    rows: DataFrame, n_folds: int = 5, key: str = "subject_id", label: str = "label", seed: int = 42
) -> DataFrame:
    """Fold number per subject, balanced within each label; rows of a subject stay together.

    A subject's fold is its position among the hashed subjects of the same label, so every
    label is spread evenly. Positions are running counts over ranges of the hash, so a label of
    many subjects is ranked by many tasks.
    """
    subjects = rows.groupBy(key).agg(F.min(label).alias("_label"))
    hashed = subjects.select(key, "_label", F.xxhash64(key, F.lit(seed)).alias("_h"), F.lit(1).alias("_one"))
    placed = running_totals(hashed, ["_label"], "_h", {"_at": "_one"})
    return rows.join(placed.select(key, ((F.col("_at") - 1) % n_folds).cast("int").alias("fold")), key)
