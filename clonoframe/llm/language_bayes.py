"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts, per language, the 1- to 3-grams of all whole training texts in ``BUCKETS``
hashed buckets. A task keeps one table per language and emits its non-zero cells; Spark sums
them, so a language holding a third of the rows is summed in every task before the shuffle. The
model is a matrix of log-probabilities, BUCKETS x languages of eight bytes; its size is bounded
by ``LANGUAGES`` and checked before it is broadcast.

Prediction is one scan: a batch's n-grams select rows of the matrix, which are summed per text,
in pieces of bounded size. An n-gram lies inside one text, whole texts between two spaces, so a
text's counts and score do not depend on its neighbours or on the pieces. The score is the winner's posterior probability with the evidence of
a text counted as at most ``EVIDENCE`` n-grams, so that long texts do not all score 1.

Defined cases: ``und`` with score 0 for null text, for text without a letter, and when there
was nothing to learn from; texts are lower-cased; ties go to the language first in code-point
order; repeated rows count and score alike; rows without a language are not learnt from; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoframe.llm.hashing import chunks

BUCKETS = 1 << 15
LANGUAGES = 256
SMOOTHING = 0.1
EVIDENCE = 200
PIECE = 1 << 18  # code points handled at a time
GATHERED = 1 << 23  # log-probabilities gathered at a time, 64 MB
UNKNOWN = "und"


def _windows(texts: Sequence[str], piece: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Batches of texts: first, end, code points, sizes, and how many n-grams may begin.

    Texts are lower-cased and stand between two spaces. A very long text comes in pieces that
    overlap by two code points, in which no n-gram begins but in the last one.
    """
    for a, b in chunks(texts, piece):
        padded = [f" {t.lower()} " for t in texts[a:b]]
        if b - a > 1 or len(padded[0]) <= piece:
            yield a, b, *_codes(padded), sum(map(len, padded))
            continue
        for at in range(0, len(padded[0]), piece):
            yield a, b, *_codes([padded[0][at : at + piece + 2]]), piece


def _codes(padded: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after another, and the size of each."""
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.array([len(t) for t in padded])


def _grams(points: np.ndarray, sizes: np.ndarray, begin: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1-, 2- and 3-grams: their buckets, and the number that begin in each text."""
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))  # code points from here to the text's end
    left[begin:] = 0
    owner = np.repeat(np.arange(len(sizes)), sizes)
    code = points * np.uint32(0x9E3779B1)
    for n, odd in ((1, 0), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
        if n > 1:
            code = (code[:-1] ^ points[n - 1 :]) * np.uint32(odd)
        inside = left[: len(code)] >= n
        yield code[inside] >> shift, np.bincount(owner[: len(code)][inside], minlength=len(sizes))


def _sums(values: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``per_text`` of them for each text."""
    out = np.zeros((len(per_text), values.shape[1]))
    some = np.flatnonzero(per_text)
    if len(some):
        starts = np.cumsum(per_text) - per_text
        out[some] = np.add.reduceat(values, starts[some])
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages) log-probabilities
    prior: np.ndarray

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of whole texts."""
        body = [t or "" for t in texts]
        sums = np.zeros((len(body), len(self.languages)))
        grams = np.zeros(len(body))
        piece = max(1, min(PIECE, GATHERED // max(1, len(self.languages))))
        for a, b, *window in _windows(body, piece):
            for bucket, per_text in _grams(*window):
                sums[a:b] += _sums(self.table[bucket], per_text)
                grams[a:b] += per_text
        names = [UNKNOWN] * len(body)
        scores = np.zeros(len(body))
        if not self.languages:
            return names, scores
        weight = np.minimum(1.0, EVIDENCE / np.maximum(grams, 1))
        odds = sums * weight[:, None] + self.prior
        odds -= odds.max(axis=1, keepdims=True)
        posterior = np.exp(odds)
        posterior /= posterior.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        for i, text in enumerate(body):
            if any(map(str.isalpha, text)):
                names[i], scores[i] = self.languages[best[i]], posterior[i, best[i]]
        return names, scores


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all whole texts with a language; bucket -1 counts the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang", sort=False):
                own = tables.setdefault(str(lang), np.zeros(BUCKETS + 1, np.int64))
                own[BUCKETS] += len(rows)
                for _, _, *window in _windows(rows["text"].tolist(), PIECE):
                    for bucket, _ in _grams(*window):
                        own[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        for lang, own in tables.items():
            some = np.flatnonzero(own)
            yield pd.DataFrame(
                {"lang": lang, "bucket": np.where(some == BUCKETS, -1, some), "n": own[some]}
            )

    rows = docs.where("lang is not null").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    cells = rows.mapInPandas(run, "lang string, bucket int, n long")
    return cells.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model:
    """The model of the rows of ``docs`` (text, lang); BUCKETS + 1 counts a language are fetched."""
    names = sorted(r["lang"] for r in docs.where("lang is not null").select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the model would not be small")
    got = counts(docs).toPandas()
    table = np.zeros((BUCKETS, len(names)))
    seen = np.zeros(len(names))
    at = got["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(int)
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    some = bucket >= 0
    table[bucket[some], at[some]] = n[some]
    seen[at[~some]] = n[~some]
    table = np.log(table + SMOOTHING) - np.log(table.sum(axis=0) + SMOOTHING * BUCKETS)
    return Model(names, table, np.log((seen + 1) / (seen.sum() + max(1, len(names)))))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (replacing columns of these names)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict(text.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    found = F.pandas_udf(run, "lang_pred string, score double")
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*rest, found("text").alias("_found")).select(*rest, "_found.*")
