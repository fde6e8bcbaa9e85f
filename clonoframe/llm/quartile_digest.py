"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every byte of a text (UTF-8) is the end of three triplets with the bytes up to three places
before it; each triplet counts in one of 256 buckets. The three quartiles of the counts turn
each bucket into two bits, by the quarter its count lies in. The digest is hexadecimal: two
digits for the logarithm of the length, two for the ratios of the quartiles, 128 for the buckets.

The difference of two digests adds, per bucket, how many quarters they are apart (3 apart counts
6, as it means more), and a bounded part for length and quartile ratios; it is cut off at
``FARTHEST``, the expected difference of unrelated digests, and ``likeness`` is its complement on
a scale of 0 to 1.

Work is one pass over whole texts in fixed pieces of ``PIECE`` bytes; documents meet their
successor (for edited texts) by one shuffle into ranges of ids, sorted inside; each range also
gets the first document of the next one, so no row meets more than its neighbour.

Defined cases: null text is empty; a text under three bytes has the digest of its length with
no bucket set; equal texts have equal digests; documents of one id follow each other by text; a
null id comes first; a single document is its own successor; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoframe.llm.shared import held_id, id_ranges, shuffle_partitions

BUCKETS = 256
PIECE = 1 << 19
#: Difference at which likeness is 0.
FARTHEST = 256

_MIX = np.random.default_rng(3).permutation(1 << 16).astype(np.uint16)  # constants only
_STEP = np.array(
    [[(0, 1, 2, 6)[abs(a - b)] for b in range(4)] for a in range(4)], np.int64
)  # bucket difference by quarters apart
_BYTE_DIFFERENCE = np.array(
    [
        [sum(int(_STEP[(a >> s) & 3, (b >> s) & 3]) for s in (0, 2, 4, 6)) for b in range(256)]
        for a in range(256)
    ],
    np.int64,
)


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of a text's triplets by bucket, in pieces that overlap by three bytes."""
    total = np.zeros(BUCKETS, np.int64)
    for start in range(0, max(len(data) - 2, 0), PIECE):
        # the first piece starts the text; later ones see the three bytes before
        from_ = max(0, start + 2 - 3) if start else 0
        b = np.frombuffer(data, np.uint8, min(len(data), start + PIECE + 2) - from_, from_)
        first = start + 2 - from_  # position of the first byte that ends triplets here
        pair = _MIX[b[first - 1 : -1].astype(np.uint16) << 8 | b[first:]]
        near = _MIX[pair ^ b[first - 2 : -2]] & 0xFF
        total += np.bincount(near, minlength=BUCKETS)
        lag = max(first, 3)  # the triplets that reach three places back
        if len(b) > lag:
            pair = pair[lag - first :]
            far = b[lag - 3 : -3].astype(np.uint16)
            total += np.bincount(_MIX[pair ^ (far << 5)] & 0xFF, minlength=BUCKETS)
            skip = _MIX[b[lag - 2 : -2].astype(np.uint16) << 8 | b[lag:]]
            total += np.bincount(_MIX[skip ^ (far << 3)] & 0xFF, minlength=BUCKETS)
    return total


def digest(text: str | None) -> str:
    """The digest of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    low, middle, high = np.quantile(counts, (0.25, 0.5, 0.75), method="lower")
    quarter = (counts > low).astype(np.uint8) + (counts > middle) + (counts > high)
    packed = quarter.reshape(-1, 4) @ np.array([64, 16, 4, 1])
    length = min(255, int(np.log(len(data) + 1) / np.log(1.1)))
    ratio_low = min(15, int(16 * low / high)) if high else 0
    ratio_middle = min(15, int(16 * middle / high)) if high else 0
    head = bytes([length, ratio_low << 4 | ratio_middle])
    return (head + packed.astype(np.uint8).tobytes()).hex()


def difference(one: str, two: str) -> int:
    """Bounded difference score of two digests: 0 for equal ones, at most ``FARTHEST``."""
    a, b = bytes.fromhex(one), bytes.fromhex(two)
    score = int(_BYTE_DIFFERENCE[np.frombuffer(a, np.uint8, offset=2), np.frombuffer(b, np.uint8, offset=2)].sum())
    score += min(12, abs(a[0] - b[0]))
    for shift in (0, 4):
        score += min(6, abs((a[1] >> shift & 15) - (b[1] >> shift & 15)))
    return min(score, FARTHEST)


def likeness(one: str, two: str) -> float:
    return 1 - difference(one, two) / FARTHEST


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def digests(texts: Sequence[str | None]) -> list[str]:
    return [digest(t) for t in texts]


def fingerprinter():
    """Column function: the digest of a text column."""
    return F.pandas_udf(lambda text: pd.Series(digests(text.tolist()), dtype=object), "string")


def neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(range, last, doc_id, text) sorted so that every document's successor is the next row.

    Rows with ``last`` set close their range: they are the first document of the range after it
    (after the last range, of the first). Of wide rows only those few are read twice.
    """
    rows = docs.select(held_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or shuffle_partitions(docs.sparkSession)
    ids = rows.select("doc_id")
    number = id_ranges(ids, parts)
    firsts = sorted(
        (r["part"], r["doc_id"])
        for r in ids.groupBy(number.alias("part")).agg(F.min("doc_id").alias("doc_id")).collect()
    )  # at most one id per range
    placed = rows.select(number.alias("part"), F.lit(False).alias("last"), "doc_id", "text")
    if firsts:
        before = {
            doc_id: firsts[i - 1][0] for i, (_, doc_id) in enumerate(firsts)
        }  # the first id of a range closes the range before it
        part = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        heads = (
            rows.where(F.col("doc_id").isin(list(before)))
            .groupBy("doc_id")
            .agg(F.min("text").alias("text"))
            .select(part[F.col("doc_id")].alias("part"), F.lit(True).alias("last"), "doc_id", "text")
        )
        placed = placed.unionAll(heads)
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions(
        "part", "last", "doc_id", "text"
    )


def with_next(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, str, str, str, str]]:
    """(doc_id, text, digest, next text, next digest) of ``neighbours`` rows, one row held back."""
    held = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            own = digest(row.text)
            if held is not None:
                yield (*held, row.text, own)
            held = None if row.last else (row.doc_id, row.text, own)


def pieces(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Lists of up to ``size`` rows."""
    for group in zip_longest(*[iter(rows)] * size):
        yield [r for r in group if r is not None]

