"""Similarity network: pairs of distinct sequences a few edits apart, degrees and components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clonoframe.session import cut_lineage, partitions, shuffles_for, shuffles_removed, staged

#: Members of a deletion bucket that meet in one task; larger buckets are split.
BLOCK = 1000
#: Rows of a shuffle's partition; variants and edges are many times the sequences.
ROWS_PER_TASK = 500_000
#: Variants of the deletion index that are shuffled at a time.
ROUND_ROWS = 400_000_000


def _with_positions(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("seq")))).withColumn(
        "_cut",
        F.concat(
            F.substring("seq", F.lit(1), F.col("_at") - 1),
            F.expr("substring(seq, _at + 1)"),
        ),
    )


def edit_network(sequences: DataFrame, column: str = "cdr3_aa") -> DataFrame:
    """Edges (left < right) between distinct sequences at edit distance exactly 1.

    Substitutions: sequences that agree after removing the letter at the same position. Such
    a set holds at most one sequence per alphabet letter. Insertions and deletions: a
    sequence minus one letter equals a shorter sequence, an equi-join. Both only produce
    true edges, so there is no candidate list to verify.
    """
    seqs = sequences.select(F.col(column).alias("seq")).filter(F.length("seq") > 0).distinct()
    cut = _with_positions(seqs)
    peers = cut.groupBy("_at", "_cut").agg(F.sort_array(F.collect_set("seq")).alias("_set"))
    substituted = (
        peers.filter(F.size("_set") > 1)
        .select(F.posexplode("_set").alias("_i", "left_seq"), "_set")
        .select(
            "left_seq",
            F.explode(F.slice("_set", F.col("_i") + 2, F.size("_set"))).alias("right_seq"),
        )
    )
    shorter = seqs.select(F.col("seq").alias("_cut"))
    shifted = (
        cut.select(F.col("seq").alias("_long"), "_cut")
        .distinct()
        .join(shorter, "_cut")
        .select(
            F.least("_cut", "_long").alias("left_seq"),
            F.greatest("_cut", "_long").alias("right_seq"),
        )
    )
    return substituted.unionByName(shifted)


def deletion_index(seqs: DataFrame, distance: int) -> DataFrame:
    """(seq, variant): what is left of a sequence after up to ``distance`` deletions, each once.

    One round of deletions cuts at or behind the last cut. Of the cuts that leave the same variant only
    those count whose letters kept behind a cut do not occur in it (what is left is then matched as
    early as can be), so a task knows without the others that it lists a variant once.
    """
    after = "substring(variant, _from, 1)"
    settled = f"(_from > length(variant) or instr(_gone, {after}) = 0)"
    made = seqs.select("seq", F.col("seq").alias("variant"), F.lit(1).alias("_from"), F.lit("").alias("_gone"))
    every = made.select("seq", "variant")
    for _ in range(distance):
        cuts = F.expr(f"if({settled}, sequence(_from, greatest(length(variant), _from)), array(_from))")
        made = made.withColumn("_at", F.explode(cuts)).where("_at <= length(variant)").select(
            "seq",
            F.expr("concat(substring(variant, 1, _at - 1), substring(variant, _at + 1))").alias("variant"),
            F.col("_at").alias("_from"),
            F.expr("concat(if(_at = _from, _gone, ''), substring(variant, _at, 1))").alias("_gone"),
        )
        every = every.unionByName(made.where(settled).select("seq", "variant"))
    return every


def edit_pairs(sequences: DataFrame, column: str = "cdr3_aa", distance: int = 2) -> DataFrame:
    """(left_seq, right_seq, distance) of distinct sequences up to ``distance`` edits apart.

    Two such sequences share a variant after at most ``distance`` deletions each, so they meet
    in a bucket of the deletion index. Each meeting is verified by the banded edit distance,
    which stops at the bound. The index is many times the sequences, so it is gone through in rounds of
    about ``ROUND_ROWS`` variants, told apart by a hash; a round shuffles the hashes once, and its
    files go when its pairs are known. A bucket is never gathered: its members are numbered by a
    hash into blocks of about ``BLOCK``, a member waits in its own block and visits every block, so hot
    variants (those of very short sequences) are spread over tasks. Shuffles get partitions by the
    number of variants and visits, and only verified pairs are shuffled. Empty and null sequences
    are left out.
    """
    spark = sequences.sparkSession
    seqs = cut_lineage(sequences.select(F.col(column).alias("seq")).filter(F.length("seq") > 0).distinct())
    choices, ways = F.lit(1.0), F.lit(1.0)
    for i in range(distance):
        ways = ways * F.greatest(F.length("seq") - i, F.lit(0)) / (i + 1)
        choices = choices + ways
    total = seqs.agg(F.sum(choices)).first()[0] or 0
    rounds = max(1, -(-int(total) // ROUND_ROWS))
    with shuffles_for(spark, total, ROWS_PER_TASK):
        # a number of its own, as small sequences merged into few tasks would make all variants there
        dealt = cut_lineage(seqs.repartition(partitions(spark), "seq"))
    # variants whose hashes agree only meet in vain
    index = deletion_index(dealt, distance).select(F.xxhash64("variant").alias("_key"), "seq")
    found = [_round_pairs(index.where(F.pmod("_key", F.lit(rounds)) == r), total / rounds, distance) for r in range(rounds)]
    if rounds == 1:
        return found[0]
    pairs = reduce(DataFrame.unionByName, found)
    with shuffles_for(spark, pairs.count(), ROWS_PER_TASK), shuffles_removed(spark):
        return staged(pairs.distinct())


def _round_pairs(index: DataFrame, size: float, distance: int) -> DataFrame:
    """The verified pairs of a part of the index."""
    spark = index.sparkSession
    with shuffles_for(spark, size, ROWS_PER_TASK), shuffles_removed(spark):
        sizes = index.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("_key"))).where("_n > 1")
        members = sizes.select("_key", "seq", F.expr(f"1 + _n div {BLOCK}").alias("_blocks")).persist()
        visits = members.agg(F.sum(F.col("_blocks") + 1)).first()[0] or 0
    waiting = members.select(
        "_key", F.pmod(F.xxhash64("seq"), F.col("_blocks")).alias("_block"),
        F.col("seq").alias("right_seq"),
    )
    visiting = members.select(
        "_key", F.explode(F.expr("sequence(0L, _blocks - 1)")).alias("_block"),
        F.col("seq").alias("left_seq"),
    )
    with shuffles_for(spark, visits, ROWS_PER_TASK), shuffles_removed(spark):
        met = visiting.join(waiting, ["_key", "_block"]).where("left_seq < right_seq")
        # fewer edits than the difference in length are impossible, and lengths differ by the cuts
        near = met.where(F.abs(F.length("left_seq") - F.length("right_seq")) <= distance)
        apart = F.levenshtein("left_seq", "right_seq", distance)
        pairs = near.select("left_seq", "right_seq", apart.alias("distance"))
        pairs = staged(pairs.where(F.col("distance").between(1, distance)).distinct())
    members.unpersist()
    return pairs


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("left_seq").alias("seq")).unionAll(edges.select("right_seq"))
    return ends.groupBy("seq").agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(seq, component): the smallest sequence reachable, for every sequence with an edge.

    Every node is hung on its least neighbour, if that is less than the node. Those trees are found
    over one row a node, and what joins them is far less than the edges, which are read for their
    least neighbours and for the trees they join, and shuffled whole once.
    """
    with shuffles_removed(edges.sparkSession):
        edges = edges.where("left_seq != right_seq")
        ends = edges.select(F.col("left_seq").alias("u"), F.col("right_seq").alias("v"))
        both = ends.unionAll(edges.select("right_seq", "left_seq"))
        nodes = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("v")))
        trees = staged(_stars(nodes.where("u != v")))
        tree = F.coalesce("component", "u")
        half = staged(_placed(ends, trees).select(F.col("v").alias("u"), tree.alias("v")).distinct())
        tops = staged(_stars(_placed(half, trees).select(tree.alias("u"), "v").where("u != v")))
        under = _placed(nodes.select("u"), trees).select(F.col("u").alias("seq"), tree.alias("u"))
        return staged(_placed(under, tops).select("seq", tree.alias("component")))


def _placed(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows with the component of ``u``, where it has one."""
    return rows.join(places.withColumnRenamed("seq", "u"), "u", "left")


def _stars(edges: DataFrame) -> DataFrame:
    """(seq, component) of the nodes of edges u, v.

    Alternating star rounds: every node hands its larger (then its smaller) neighbours to its
    smallest one, which ends with each component a star. The number of rounds grows with the
    logarithm of the network, each round is an aggregate and a join on checkpointed edges, and
    only two numbers a round reach the driver.
    """
    pairs = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        # large star: nodes above u meet the least of u and its neighbours
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = large.distinct()
        # small star: nodes below u, and u itself, meet the least of them
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        met = pairs.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        pairs = cut_lineage(small.where("u != v").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = pairs.select(F.col("u").alias("seq"), F.col("v").alias("component"))
    return stars.unionAll(pairs.select(F.col("v").alias("seq"), F.col("v").alias("component")).distinct())


def network_nodes(sequences: DataFrame, column: str = "cdr3_aa", distance: int = 2) -> DataFrame:
    """(seq, degree, component, component_size) of every distinct sequence, lone ones included."""
    spark = sequences.sparkSession
    seqs = sequences.select(F.col(column).alias("seq")).filter(F.length("seq") > 0).distinct()
    edges = edit_pairs(sequences, column, distance)
    with shuffles_for(spark, 2 * edges.count(), ROWS_PER_TASK), shuffles_removed(spark):
        placed = cut_lineage(
            seqs.join(degrees(edges), "seq", "left")
            .join(components(edges), "seq", "left")
            .select("seq", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), F.coalesce("component", "seq").alias("component"))
        )
        sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
        return cut_lineage(placed.join(sizes, "component").select("seq", "degree", "component", "component_size"))
