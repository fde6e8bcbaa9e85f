"""Source divergence audit: how the sources of a language differ in the terms they use.

A term is a run of letters A-Z, a-z or code points above 127, with A-Z lower-cased. One
``bytes.translate`` call lowers the letters of a text and blanks every separator, ``bytes.split``
cuts the terms, and a ``Counter`` per document gives its frequencies; a task adds the counters of
a (lang, source) group up and passes on one row per group and term.

A language keeps the terms in at least ``MIN_DOCS`` of its documents. Each group, and each
language as a whole, gives a kept term the smoothed share ``1 + floor(SCALE (c + 1) / (N + V))``
(c occurrences of N, V kept terms), and two shares p, q are ``floor((p - q)^2 / q)`` apart. All of
it is exact in 64 bits while a language has fewer than 9e13 occurrences.

* ``term_parts``: per group the ``TOP`` kept terms most over-used against the whole language.
* ``pair_parts``: per ordered pair of sources the distance summed over *all* kept terms. Absent
  terms are never written out: the sum is V times the distance of two absences, plus a correction
  per present cell, plus one per term both sources have. A language's cells are dealt by term
  into buckets of about ``BUCKET`` cells, each with the language's list of sources, so a hot
  language or source is spread over many tasks. A task holds one number per pair of sources, the
  size of that language's share of the result.

Defined cases: null text, lang and source are ''; a repeated row is one more document; a group
without kept terms takes part with count 0; a language without kept terms gives pairs of value 0
and no terms; ties are ranked by the UTF-8 bytes of the item; other columns are ignored; an empty
table gives an empty result. Very long texts are split in pieces of ``PIECE`` bytes at separators.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoframe.llm.shared import staged

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
BUCKET = 50_000  # cells (group, term) compared in one go
PIECE = 1 << 22  # bytes split at once
HELD = 300_000  # terms a task adds up before it passes them on
PAIRS = 1 << 19  # pairs of cells compared at once

#: Lowers A-Z, keeps a-z and the bytes of code points above 127, blanks the rest.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20
    for b in range(256)
)
CELLS = "lang string, source string, term string, n long, docs long"
_ARROW = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
)


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each term of one text, as lower-cased UTF-8 bytes."""
    data, at, counts = (text or b"").translate(TABLE), 0, Counter()
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        counts.update(data[at:end].split())
        at = end
    return counts


class _Sums:
    """Occurrences and documents by group and term, passed on when many are held."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.held = 0

    def add(self, group: tuple[str, str], counts: Counter) -> None:
        total, docs = self.groups.setdefault(group, (Counter(), Counter()))
        before = len(docs)
        total.update(counts)
        docs.update(counts.keys())
        self.held += len(docs) - before

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, docs) in self.groups.items():
            # an empty term stands for the group itself
            terms = [b"", *docs]
            n = [0, *(total[t] for t in docs)]
            seen = [0, *docs.values()]
            columns = [[lang] * len(terms), [source] * len(terms), terms, n, seen]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)
        self.groups, self.held = {}, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for i, group in enumerate(zip(langs, sources, strict=True)):
            text = batch.column("text")[i].as_buffer()
            sums.add(group, term_counts(text.to_pybytes() if text is not None else None))
            if sums.held >= HELD:
                yield from sums.flush()
    yield from sums.flush()


def cells(docs: DataFrame) -> DataFrame:
    """Staged (lang, source, term, n, docs); the row of the empty term stands for the group."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(_count, CELLS)
    return staged(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: Column, size: Column) -> Column:
    """1 + floor(SCALE (n + 1) / size), in two steps that stay within 64 bits."""
    high = (n + 1) * 100_000
    return F.call_function("div", high, size) * 10_000 + F.call_function("div", high % size * 10_000, size) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """Kept cells with their totals, and the sizes of groups and languages, each staged once."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS) -> None:
        found = cells(docs)
        term = Window.partitionBy("lang", "term")
        self.kept = staged(
            found.where("term != ''")
            .withColumns(
                {
                    "in_docs": F.sum("docs").over(term),
                    "lang_n": F.sum("n").over(term),
                    # one cell of each term counts it
                    "is_first": F.row_number().over(term.orderBy("source")) == 1,
                }
            )
            .where(F.col("in_docs") >= min_docs)
            .select("lang", "source", "term", "n", "lang_n", "is_first")
        )
        langs = self.kept.groupBy("lang").agg(
            F.sum(F.col("is_first").cast("long")).alias("v"), F.sum("n").alias("lang_total"),
            (F.lit(1) + F.call_function("div", F.count("*"), F.lit(BUCKET))).alias("buckets"),
        )
        sizes = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        self.groups = staged(
            found.where("term = ''")
            .select("lang", "source")
            .join(sizes, ["lang", "source"], "left")
            .join(langs, "lang", "left")
            .na.fill({"total": 0, "v": 0, "lang_total": 0, "buckets": 1})
        )

    def term_parts(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): over-used terms, most telling first."""
        rows = self.kept.join(self.groups, ["lang", "source"])
        p = share(F.col("n"), F.col("total") + F.col("v"))
        q = share(F.col("lang_n"), F.col("lang_total") + F.col("v"))
        rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        rows = rows.where("p > q").withColumn("value", apart(F.col("p"), F.col("q")))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return ranked.select("lang", "source", "item", "value", "rank")

    def pair_parts(self) -> DataFrame:
        """(lang, source, item, value, rank): every other source, the most distant first."""
        spread = self.groups.select("lang", "buckets").distinct()
        bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket")
        dealt = self.kept.join(spread, "lang").select("lang", bucket, "source", "term", "n")
        beside = self.groups.select(
            "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"),
            "source", "total", "v",
        )
        keys = ("lang", "bucket")
        parts = (
            dealt.groupBy(*keys)
            .cogroup(beside.groupBy(*keys))
            .applyInPandas(_compare, "lang string, source string, item string, value long")
        )
        summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return summed.withColumn("rank", F.row_number().over(order))


def _shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    high = (n + 1) * 100_000
    return high // size * 10_000 + high % size * 10_000 // size + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(source: np.ndarray, term: np.ndarray, n: np.ndarray, size: np.ndarray, v: int) -> np.ndarray:
    """(sources, sources) distances over v kept terms, from the cells present.

    ``source`` and ``term`` number the source and term of a cell with n occurrences; ``size`` is
    N + V of each source.
    """
    none = _shares(np.zeros(len(size), np.int64), size)  # the share of an absent term
    absent = _apart(none[:, None], none[None, :])
    out = v * absent
    p = _shares(n, size[source])
    # present here, absent there: alike cells of a source are looked at once
    alike, many = np.unique(np.stack([source, p]), axis=1, return_counts=True)
    for a in range(0, alike.shape[1], max(1, PAIRS // len(size))):
        s, x = alike[:, a : a + max(1, PAIRS // len(size))]
        m = many[a : a + len(s)][:, None]
        np.add.at(out, s, m * (_apart(x[:, None], none[None, :]) - absent[s]))
        np.add.at(out.T, s, m * (_apart(none[None, :], x[:, None]) - absent.T[s]))
    # present on both sides: put right what the two single corrections assume
    order = np.argsort(term, kind="stable")
    source, p, term = source[order], p[order], term[order]
    first = np.flatnonzero(np.diff(term, prepend=-1))
    width = np.diff(np.append(first, len(term)))
    work = np.cumsum(width**2)
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS, "right")))
        w = width[at:end]
        left = np.repeat(np.arange(first[at], first[at] + w.sum()), np.repeat(w, w))
        inside = np.arange(len(left)) - np.repeat(np.cumsum(w**2) - w**2, w**2)
        right = np.repeat(first[at:end], w**2) + inside % np.repeat(w, w**2)
        i, j, x, y = source[left], source[right], p[left], p[right]
        both = _apart(x, y) - _apart(x, none[j]) - _apart(none[i], y) + absent[i, j]
        np.add.at(out, (i, j), both)
        at = end
    return out


def _compare(key: tuple, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    lang, bucket = key
    names = np.array(sorted(groups["source"]), object)
    rows = groups.set_index("source").loc[names]
    v = int(rows["v"].iloc[0])
    if v:
        size = rows["total"].to_numpy(np.int64) + v
        source = pd.Index(names).get_indexer(cells["source"])
        term = pd.factorize(cells["term"])[0]
        # the terms absent from both are counted in the first bucket alone
        value = pair_sums(source, term, cells["n"].to_numpy(np.int64), size, v if bucket == 0 else 0)
    else:
        value = np.zeros((len(names), len(names)), np.int64)
    i, j = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"lang": lang, "source": names[i], "item": names[j], "value": value[i, j]})


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    made = Audit(docs)
    parts = [
        part.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
        for name, part in (("pair", made.pair_parts()), ("term", made.term_parts()))
    ]
    return parts[0].unionByName(parts[1])
