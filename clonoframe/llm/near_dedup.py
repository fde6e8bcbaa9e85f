"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact links.

1. One pass over the texts makes, per document, the set of distinct word shingles (hashed to
   64 bits), an order-free key of the set, band keys, and one byte per MinHash value.
2. Documents with equal sets form a class (they are linked by definition); only its smallest
   id goes on. The count is partial-aggregated, so a group of copies is never gathered.
3. Band buckets give candidates without emitting all pairs of a bucket. In ``ROUNDS`` rounds
   every member outside the bucket's main component is paired with one leader out of it, and
   each document verifies its likeliest pair. That joins large groups of near copies, and a
   bucket whose members share a component is done. Members of buckets still open then meet by a
   prefix filter over their full sets, which is exact and looks at different components only.
4. Candidates are compared signature batch by signature batch. After each, a pair is dropped
   if the posterior probability of reaching the threshold is below ``MISS`` (uniform prior).
5. Survivors are verified on their full sets, so every link is exact. A pair at the threshold
   is missed with probability ``(1 - t^rows)^bands`` < 6e-6 by the bands, and at most ``MISS`` per
   comparison batch.
6. Links become components by alternating large-star and small-star rounds on staged edges.

Classes are numbered on their own, so what is linked are sets; ids come back at the end.

Defined cases: null or wordless text has no shingles and is linked with nothing; fewer words
than the shingle width make one shingle of the whole text; rows with one id are one document
with the union of their links, in whatever order they come, and each has a result row; a null id
is linked with nothing, keeps a null component and is kept; ``deduplicated`` keeps, of a kept id,
one row per distinct set (the first by text) and every row without words once per text; other
columns are ignored, or returned untouched by ``deduplicated``; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonoframe.llm.hashing import chunks, min_hashes, mix, shingle_sets
from clonoframe.llm.shared import joined_evenly, staged

WIDTH = 5
THRESHOLD = 75  # per cent, compared in integers
BANDS, ROWS = 32, 4
BATCH = 32  # signature bytes compared at once
MISS = 1e-6
ROUNDS = 2  # of leader pairs, before the remaining pairs are looked at
SKETCH_CELLS = 1 << 18  # of the frequency sketch that orders shingles

SKETCH = "doc_id long, text_key long, n long, s1 long, s2 long, bands array<long>, sig binary"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, keys, texts = batch["doc_id"].to_numpy(), batch["text_key"].to_numpy(), batch["text"].tolist()
        for a, b in chunks(texts):
            sets = shingle_sets(texts[a:b], WIDTH)
            mins = min_hashes(sets, BANDS * ROWS)
            wide = mins.astype(np.uint64).reshape(len(sets), BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), wide.shape[:2]).copy()
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r])
            low = (mins * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            yield pd.DataFrame(
                {"doc_id": ids[a:b], "text_key": keys[a:b]}
                | _set_key(sets)
                | {"bands": list(_signed(key)), "sig": [row.tobytes() for row in low]}
            )


def _set_key(sets: list[np.ndarray]) -> dict[str, np.ndarray | list]:
    """Size and order-free key of each set."""
    return {
        "n": [len(s) for s in sets],
        "s1": _signed(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)),
        "s2": _signed(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)),
    }


def sketches(docs: DataFrame) -> DataFrame:
    """One row per input row with a doc_id: set size, set key, band keys, signature bytes."""
    return _keyed(docs).where("doc_id is not null").mapInPandas(_sketches, SKETCH)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")


@lru_cache
def least_agreement(n: int, miss: float = MISS) -> int:
    """Fewest agreeing bytes of n that keep P(similarity >= threshold | agreement) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t equals
    P(Binomial(n + 1, t) <= m). Bytes also agree by chance in 1 of 256, which t takes in.
    """
    t = THRESHOLD / 100
    t += (1 - t) / 256
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def _screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if not len(batch):
            continue
        left = np.frombuffer(b"".join(batch["sig_a"]), np.uint8).reshape(len(batch), -1)
        right = np.frombuffer(b"".join(batch["sig_b"]), np.uint8).reshape(len(batch), -1)
        alive, agree = np.arange(len(batch)), np.zeros(len(batch), np.int64)
        for start in range(0, left.shape[1], BATCH):
            part = slice(start, start + BATCH)
            agree[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
            alive = alive[agree[alive] >= least_agreement(start + BATCH)]
        yield pd.DataFrame(
            {c: batch[c].to_numpy()[alive] for c in ("a", "b", "seeker")} | {"agree": agree[alive]}
        )


def screened(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) that survive the size bound and every signature batch."""
    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    sized = pairs.join(one, "a").join(two, "b").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * THRESHOLD
    )
    return sized.select("a", "b", "seeker", "sig_a", "sig_b").mapInPandas(
        _screen, "a long, b long, seeker long, agree long"
    )


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, texts = batch["rep"].to_numpy(), batch["text"].tolist()
        for a, b in chunks(texts):
            yield pd.DataFrame(
                {"id": ids[a:b], "hashes": [s.tobytes() for s in shingle_sets(texts[a:b], WIDTH)]}
            )


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["h_a"], batch["h_b"], strict=True):
            one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(100 * common >= THRESHOLD * (len(one) + len(two) - common))
        yield batch.loc[np.array(keep, bool), ["a", "b"]]


def shingled(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Staged (id, hashes): the full shingle sets of the given classes (rep, doc_id, text_key).

    A class is read from the text of its smallest document; the text's hash tells it from other
    texts of that id. The join is a shuffle at every size, so that costs grow with the texts.
    """
    texts = _keyed(docs).join(reps.hint("merge"), ["doc_id", "text_key"]).select("rep", "text")
    return staged(texts.mapInPandas(_sets, "id long, hashes binary").dropDuplicates(["id"]))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("h_a"))
    two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("h_b"))
    return pairs.join(one, "a").join(two, "b").mapInPandas(_links, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id: the smallest id reachable over the links a-b."""
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == mark or state[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
                edges.select(F.col("v"), F.col("v")).distinct()
            )
        mark = state
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of buckets that still hold more than one component, with the commonest one."""
    if labels is None:  # every representative is its own component
        labels = members.select(F.col("rep").alias("id"), F.col("rep").alias("component")).limit(0)
    own = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("comp")
    )
    sizes = own.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_keys = (
        sizes.groupBy("key")
        .agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"))
        .where("comps > 1")
        .drop("comps")
    )
    return own.join(open_keys, "key")


def _led(rows: DataFrame, number: int) -> DataFrame:
    """One pair per member outside its bucket's main component, with a leader out of that.

    In the first round the leader is the smallest member, the same in many buckets, so that few
    distinct pairs arise; later it differs by bucket and round.
    """
    order = F.col("rep") if number == 0 else F.xxhash64("key", "rep", F.lit(number))
    leader = rows.where("comp = main").groupBy("key").agg(F.min_by("rep", order).alias("lead"))
    pairs = rows.where("comp <> main").join(leader, "key")
    return pairs.select(
        F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"),
        F.col("rep").alias("seeker"),
    ).distinct()


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SKETCH_CELLS, np.int64)
    for batch in batches:
        for data in batch["hashes"]:
            cells = (np.frombuffer(data, np.uint64) % np.uint64(SKETCH_CELLS)).astype(np.int64)
            total += np.bincount(cells, minlength=SKETCH_CELLS)
    some = np.flatnonzero(total)
    yield pd.DataFrame({"cell": some, "n": total[some]})


def _by_prefix(rows: DataFrame) -> DataFrame:
    """Pairs (a < b) of different components that may reach the threshold, without band buckets.

    All sets are ordered alike, rarest shingle first by a frequency sketch of fixed size. A pair
    at the threshold shares one of the first n - ceil(t n) + 1 shingles of either set (prefix
    filter), and from the first shared one on enough must be left in both (positional filter).
    The second test depends on sizes and positions only, so it is made once for all rows of a
    shingle that agree in them: text that many documents share gives no pairs unless the
    documents consist of little else.
    """
    rows = staged(rows)
    cells = rows.select("hashes").mapInPandas(_frequencies, "cell long, n long")
    counted = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(SKETCH_CELLS, np.int64)
    table[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(table)  # SKETCH_CELLS x 8 bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rep, comp, data in zip(batch["rep"], batch["comp"], batch["hashes"], strict=True):
                own = np.frombuffer(data, np.uint64)
                often = shared.value[(own % np.uint64(SKETCH_CELLS)).astype(np.int64)]
                first = len(own) - -(-THRESHOLD * len(own) // 100) + 1
                prefix = own[np.lexsort((own, often))[:first]]
                yield pd.DataFrame(
                    {"token": _signed(prefix), "rep": rep, "comp": comp, "n": len(own),
                     "place": np.arange(len(prefix))}
                )

    tokens = staged(rows.mapInPandas(run, "token long, rep long, comp long, n long, place long"))
    sizes = tokens.groupBy("token", "comp").agg(F.count("*").alias("c"))
    mixed = (
        sizes.groupBy("token")
        .agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"))
        .where("comps > 1").drop("comps")
    )
    tokens = staged(tokens.join(mixed, "token"))
    shapes = tokens.groupBy("token", "n", "place").agg(F.bool_or(F.expr("comp <> main")).alias("few"))
    other = shapes.select("token", F.col("n").alias("m"), F.col("place").alias("q"))
    fitting = shapes.where("few").drop("few").join(other, "token").where(
        f"least(n - place, m - q) * {100 + THRESHOLD} >= {THRESHOLD} * (n + m)"
    )
    few = tokens.where("comp <> main").select("token", "n", "place", F.col("rep").alias("x"), F.col("comp").alias("cx"))
    near = few.join(fitting, ["token", "n", "place"]).select("token", "m", "q", "x", "cx")
    all_ = tokens.select("token", F.col("n").alias("m"), F.col("place").alias("q"), "rep", "comp", "main")
    pairs = near.join(all_, ["token", "m", "q"]).where("comp <> cx and (comp = main or rep < x)")
    return pairs.select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b")).distinct()


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, rep; classes: rep, doc_id; links between reps), all staged.

    ``rep`` numbers a class of equal sets, whose smallest id ``doc_id`` is; wordless rows have none.
    """
    rows = staged(sketches(docs))
    worded = rows.where("n > 0")
    reps = staged(
        worded.groupBy("n", "s1", "s2").agg(
            F.min(F.struct("doc_id", "text_key")).alias("source"), F.first("bands").alias("bands"),
            F.first("sig").alias("sig"), F.count("*").alias("copies"),
        )
        .select("n", "s1", "s2", "source.*", "bands", "sig", "copies")
        .withColumn("rep", F.monotonically_increasing_id())
    )
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = staged(keyed.join(groups, "key"))
    members = members.select("key", "rep")
    wanted = reps.select("rep", "doc_id", "text_key").join(members.select("rep").distinct(), "rep")
    sets = shingled(docs, wanted)
    tried = links = labels = None
    for number in range(ROUNDS):
        # each member seeks one other component: that of its bucket's leader
        rows_now = staged(_labelled(members, labels))
        pairs = screened(_led(rows_now, number), reps)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        best = staged(
            pairs.groupBy("seeker").agg(F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("p"))
            .select("p.*").distinct()
        )
        found = staged(verified(best, sets))
        tried = best if tried is None else tried.unionAll(best)
        links = found if links is None else links.unionAll(found)
        labels = staged(components(links))
    # whatever still separates components inside a bucket
    still = _labelled(members, labels).select("rep", "comp").distinct()
    pairs = _by_prefix(still.join(sets.withColumnRenamed("id", "rep"), "rep"))
    rest = screened(pairs.withColumn("seeker", F.col("b")), reps)
    rest = staged(rest.select("a", "b").join(tried, ["a", "b"], "left_anti"))
    links = links.unionAll(staged(verified(rest, sets)))
    key = ["n", "s1", "s2"]
    own = worded.select("doc_id", *key)
    classed = joined_evenly(own, reps.select(*key, "rep", "copies"), key, "copies")
    bare = rows.where("n = 0").withColumn("rep", F.lit(None).cast("long"))
    every = staged(
        classed.select("doc_id", F.col("n").alias("n_shingles"), "rep").unionAll(
            bare.select("doc_id", F.col("n").alias("n_shingles"), "rep")
        )
    )
    return every, reps.select("rep", "doc_id", "copies"), links


def _unkeyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for a, b in chunks(texts):
            yield pd.DataFrame({"n_shingles": [len(s) for s in shingle_sets(texts[a:b], WIDTH)]})


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the rows with an id."""
    rows, classes, links = linked(docs)
    # an id met with several sets joins their classes
    ids = rows.groupBy("doc_id").agg(
        F.min("rep").alias("a"), F.max("rep").alias("z"), F.count("*").alias("c"), F.count("rep").alias("worded")
    )
    several = staged(ids.where("c > 1 and (a <> z or worded between 1 and c - 1)"))
    same = (
        rows.where("rep is not null").join(several.select("doc_id", "a"), "doc_id")
        .where("rep <> a").select("a", F.col("rep").alias("b"))
    )
    labels = components(links.unionAll(same))
    placed = staged(
        classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
            "rep", "doc_id", "copies", F.coalesce("component", "rep").alias("component")
        )
    )
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = staged(placed.join(least, "component").select("rep", "component_id", "copies"))
    worded = joined_evenly(rows.where("rep is not null"), named, ["rep"], "copies")
    # a wordless row shares the component of the other rows of its id, if there are any
    besides = several.where("worded > 0").join(named, several["a"] == named["rep"]).select("doc_id", "component_id")
    bare = rows.where("rep is null").join(besides, "doc_id", "left")
    columns = ["doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")]
    return worded.select(*columns).unionAll(bare.select(*columns))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``."""
    found = _identified(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    none = docs.where("doc_id is null").select("text").mapInPandas(_unkeyed, "n_shingles long")
    null = F.lit(None).cast("long")
    return found.unionByName(
        none.select(null.alias("doc_id"), "n_shingles", null.alias("component_id"), F.lit(True).alias("kept"))
    )


def _key_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_set_key(shingle_sets(text.tolist(), WIDTH)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of one document of each group: its smallest id. See the defined cases for its rows.

    The texts meet the ids to leave out in one shuffle at every size, so that costs grow with the
    texts; only where ids repeat, their rows are read apart. Rows without an id are not shuffled.
    """
    marked = staged(_identified(docs).select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept")))
    twice = marked.where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("c"))
    twice = staged(twice.where("c > 1").drop("c"))
    gone = marked.where("not kept").select(F.col("doc_id").alias("_id")).unionAll(twice).distinct()
    number = F.col("doc_id").cast("long")
    own = number == F.col("_id")
    once = docs.where(number.isNotNull()).join(gone.hint("merge"), own, "left_anti")
    once = once.unionByName(docs.where(number.isNull()))
    if twice.isEmpty():
        return once
    # rows of a repeated id: one per set, the first by text
    key = F.pandas_udf(_key_of, "n long, s1 long, s2 long")(F.coalesce("text", F.lit("")))
    many = docs.join(twice, own, "left_semi").withColumn("_key", key)
    of = F.when(F.col("_key.n") > 0, F.struct("_key.s1", "_key.s2", "_key.n", F.lit("").alias("t"))).otherwise(
        F.struct("_key.s1", "_key.s2", "_key.n", F.coalesce("text", F.lit("")).alias("t"))
    )
    first = Window.partitionBy("doc_id", of).orderBy("text")
    many = many.withColumn("_row", F.row_number().over(first)).where("_row = 1").drop("_key", "_row")
    return once.unionByName(many)
