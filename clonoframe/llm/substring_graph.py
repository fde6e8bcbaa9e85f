"""Substring dedup by compaction of a De Bruijn graph over words.

Edges are token k-mers: the windows of ``K`` words. A document's first occurrence (smallest id)
of a window stays; every later document loses the words of that window.

1. Consecutive windows that share their minimizer (the smallest hashed ``M``-mer inside) travel
   as one super-k-mer, so about one row in 13 words leaves the tasks. Equal windows have equal
   minimizers, wherever they stand.
2. One aggregate per minimizer tells whether it repeats across documents, and whether all its
   super-k-mers are the same path (no branch) or several (a branch). What does not repeat ends.
3. Nonbranching repeated super-k-mers are the nodes that compact: a -> b is linked if b follows
   every occurrence of a and a precedes every occurrence of b, found by an aggregate of the
   neighbours and a join of the links out with the links in. Every occurrence of a linked path is
   whole and the same in all its documents, so it compacts into one long span.
4. Spans, and the single windows of branches, are read at their source coordinates and named by
   a 128-bit BLAKE2b digest of their words; the smallest document of each digest is found by an
   aggregate and joined back. Rolling hashes thus only propose; words decide.

Groups are never gathered: hot minimizers and digests meet in partial aggregates, the few digests
that hold a large share of all places are broadcast with their first document, and joins by
minimizer are left to adaptive skew handling. A document's own spans are one array.

Defined cases: null text has no words; fewer than ``K`` words make no window; windows repeated
inside one document, or in documents of one id, remove nothing; a null id takes and loses
nothing; repeated rows get equal results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoframe.llm.hashing import chunks, mix, word_hashes
from clonoframe.llm.shared import freed_id, held_id, joined_evenly, staged

K = 50  # words of a window
M = 25  # words of a minimizer
PIECE = 1 << 18  # windows hashed together

_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Rolling:
    """Hashes of word ranges by differences of one running sum."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(words * _powers(_BASE, n)[:n], dtype=np.uint64)))
        self.undo = _powers(_INVERSE, n)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.undo[start])


def first_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value of every ``width`` consecutive ones."""
    at, best, have = np.arange(len(values)), values, 1
    while have < width:
        step = min(have, width - have)
        right = best[step:]
        left = best[: len(right)]
        take = right < left
        at = np.where(take, at[step:], at[: len(right)])
        best = np.where(take, right, left)
        have += step
    return at


def super_kmers(texts: list[str | None], k: int = K, m: int = M) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first window, windows, minimizer, path) of the super-k-mers, in order.

    At most ``PIECE`` windows are looked at together; a super-k-mer cut there is two paths, which
    makes its minimizer a branch and changes no result.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, words = word_hashes(b"\n".join(raw))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    windows = np.maximum(np.diff(bounds) - k + 1, 0)
    text = np.repeat(np.arange(len(raw)), windows)  # only windows inside one text count
    inside = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = bounds[:-1][text] + inside
    for a in range(0, len(start), PIECE):
        of, first, begin = text[a : a + PIECE], inside[a : a + PIECE], start[a : a + PIECE]
        offset = begin[0]
        rolling = _Rolling(words[offset : begin[-1] + k])
        begin = begin - offset
        mmers = rolling.of(np.arange(len(rolling.undo) - m), m)
        anchor = first_minima(mmers, k - m + 1)[begin]
        new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        n = np.diff(np.append(new, len(of)))
        place = begin[new]
        path = rolling.of(place, n + k - 1) ^ mix((n + k * (anchor[new] - place)).astype(np.uint64))
        yield of[new], first[new], n, mmers[anchor[new]].view(np.int64), path.view(np.int64)


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, keys, texts = batch["doc_id"].to_numpy(), batch["key"].to_numpy(), batch["text"].tolist()
        for a, b in chunks(texts):
            for text, start, n, minimizer, path in super_kmers(texts[a:b]):
                own = {"doc_id": ids[a:b][text], "key": keys[a:b][text]}
                yield pd.DataFrame(own | {"start": start, "n": n, "minimizer": minimizer, "path": path})


PATHS = "doc_id long, key long, start int, n int, minimizer long, path long"


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its id and a hash of its text, in case an id repeats."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """Staged super-k-mers whose minimizer repeats across documents, one row per place.

    ``branch`` tells whether the minimizer has more than one path.
    """
    paths = staged(_keyed(docs).where("doc_id is not null").mapInPandas(_paths, PATHS))
    repeated = (
        paths.groupBy("minimizer")
        .agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
            (F.min("path") != F.max("path")).alias("branch"),
        )
        .where("first < last")
    )
    return staged(paths.drop("path").join(repeated.select("minimizer", "branch"), "minimizer"))


def compacted(found: DataFrame) -> DataFrame:
    """(doc_id, key, places): per document the places (start, n, branch, joined) in order.

    ``joined`` places continue the path of the place before them.
    """
    place = F.struct("start", "n", "branch", "minimizer")
    by_doc = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(place)).alias("places"))
    # the neighbours of every nonbranching place; 0 where there is none
    sides = by_doc.select(
        F.explode(
            F.expr(
                "transform(places, (p, i) -> named_struct('minimizer', p.minimizer, 'branch', p.branch,"
                " 'after', if(i + 1 < size(places) and get(places, i + 1).start = p.start + p.n"
                "   and not get(places, i + 1).branch, get(places, i + 1).minimizer, 0L),"
                " 'before', if(i > 0 and get(places, i - 1).start + get(places, i - 1).n = p.start"
                "   and not get(places, i - 1).branch, get(places, i - 1).minimizer, 0L)))"
            )
        ).alias("p")
    ).select("p.*")
    near = sides.where("not branch").groupBy("minimizer").agg(
        F.min("after").alias("after"), F.max("after").alias("after_too"),
        F.min("before").alias("before"), F.max("before").alias("before_too"),
    )
    out = near.where("after = after_too and after != 0").select(F.col("minimizer").alias("a"), F.col("after").alias("b"))
    into = near.where("before = before_too and before != 0").select(F.col("before").alias("a"), F.col("minimizer").alias("b"))
    joined = out.join(into, ["a", "b"]).select(F.col("b").alias("minimizer"), F.lit(True).alias("joined"))
    marked = found.join(joined, "minimizer", "left").withColumn("joined", F.coalesce("joined", F.lit(False)))
    return marked.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct("start", "n", "branch", "joined"))).alias("places")
    )


def spans_of(start: np.ndarray, n: np.ndarray, branch: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of compacted paths, and of single windows of branches."""
    many = n[branch]
    single = np.repeat(start[branch], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    path = ~branch
    head = np.flatnonzero(~joined[path])
    length = np.add.reduceat(n[path], head) if len(head) else head
    return np.concatenate([start[path][head], single]), np.concatenate([length, np.ones_like(single)])


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for doc_id, key, text, *places in batch.itertuples(index=False):
            start, n = spans_of(*(np.asarray(p) for p in places))
            words = text.encode("utf-8", "surrogatepass").split()
            clean = b" ".join(words)
            at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
            ends = (at[start + n + K - 1] - 1).tolist()
            names = [
                hashlib.blake2b(clean[a:b], digest_size=16).digest()
                for a, b in zip(at[start].tolist(), ends, strict=True)
            ]
            for i in range(0, len(names), 50_000):
                part = slice(i, i + 50_000)
                yield pd.DataFrame(
                    {"doc_id": doc_id, "key": key, "start": start[part], "n": n[part], "name": names[part]}
                )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Staged (doc_id, key, start, n, first): n windows from word ``start`` on that stand in ``first``.

    Only those with a smaller ``first``: what ``doc_id`` repeats of an earlier document.
    """
    places = compacted(occurrences(docs))
    columns = [F.col(f"places.{c}").alias(c) for c in ("start", "n", "branch", "joined")]
    texts = _keyed(docs).join(places, ["doc_id", "key"]).select("doc_id", "key", "text", *columns)
    named = staged(texts.mapInPandas(_named, "doc_id long, key long, start int, n int, name binary"))
    firsts = named.groupBy("name").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("places")
    )
    firsts = staged(firsts.where("first < last").drop("last"))
    found = joined_evenly(named, firsts, ["name"], "places")
    return staged(found.where("first < doc_id").drop("name"))


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, start, n in batch.itertuples(index=False):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            left = words
            if start is not None and len(start):
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + n + K - 1, -1)
                keep = np.cumsum(cover)[:-1] == 0
                left = list(compress(words, keep.tolist()))
            rows.append((doc_id, len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left of every row, joined by one space."""
    spans = repeated_spans(docs).groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("start", "n")).alias("spans")
    )
    rows = _keyed(docs).join(spans, ["doc_id", "key"], "left")
    rows = rows.select(held_id("doc_id").alias("doc_id"), "text", "spans.start", "spans.n")
    return rows.mapInPandas(
        _kept, "doc_id long, n_words long, n_removed long, kept string"
    ).withColumn("doc_id", freed_id("doc_id"))
