"""Quality classifier: a generalised additive model with pairwise interactions.

Fitting is cyclic gradient boosting: feature after feature, round after round, a tree of at
most three leaves is fitted to the logistic gradient of that feature's bins and added, with a
small step, to the feature's lookup table. Then the feature pairs with the largest gain get
tables of their own from four-leaf quadrant trees. Scoring a document adds one table entry per
feature and pair, vectorised over a batch.

The fit uses at most ``FIT_ROWS`` labelled rows, chosen by a hash of the id (a documented bound,
so the fit costs the same at any size); features and scores are computed for every whole text
where it lies: one scan, no shuffle.

Defined cases: null text is scored as empty text; without labelled rows every score is 0.5,
with one class only it is that class's smoothed share; repeated label rows count repeatedly,
null labels do not count; repeated documents get equal scores; the score depends on the text
alone, so other columns and their names do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoframe.llm.hashing import _LANES, chunks, mix, word_hashes

#: Labelled rows used for fitting, at most.
FIT_ROWS = 20_000
BINS, ROUNDS, STEP, PAIRS, PAIR_ROUNDS, RIDGE, LEAF = 32, 120, 0.1, 6, 40, 5.0, 20
KEEP = 0.7

FEATURES = (
    "log_words", "mean_word", "distinct_words", "distinct_windows", "symbols_per_word",
    "upper_share", "digit_share", "mark_share", "exclaim_share", "space_share",
    "duplicate_lines", "log_line_words",
)


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(characters.encode())] = 1
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_SYMBOL = _class("#*$%&|<>@^~=+_{}[]\\")
_MARK = _class(".,;:'\"()-")
_EXCLAIM = _class("!?")
_SPACE = _class(" \t\n\x0b\x0c\r")
_CLASSES = np.stack([_UPPER, _DIGIT, _SYMBOL, _MARK, _EXCLAIM, _SPACE], axis=1)


def features(texts: Sequence[str | None]) -> np.ndarray:
    """(texts, features) of whole texts."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in chunks(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
        starts, word = word_hashes(b"\n".join(raw))
        bounds = np.concatenate(
            ([0], np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw])))
        )
        window = np.empty(0, np.uint64)
        if len(word) > 2:
            window = mix(word[:-2] * _LANES[0] + word[1:-1] * _LANES[1] + word[2:] * _LANES[2])
        for i, data in enumerate(raw):
            first, last = bounds[i], bounds[i + 1]
            n, size = int(last - first), max(1, len(data))
            counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES
            upper, digit, symbol, mark, exclaim, space = counts
            lines = [x for x in data.split(b"\n") if x.strip()]
            n_windows = max(0, n - 2)
            out[a + i] = (
                np.log1p(n),
                (len(data) - space) / max(1, n),
                len(np.unique(word[first:last])) / max(1, n),
                len(np.unique(window[first : first + n_windows])) / n_windows if n_windows else 1,
                symbol / max(1, n),
                upper / size,
                digit / size,
                mark / size,
                exclaim / size,
                space / size,
                1 - len(set(lines)) / max(1, len(lines)) if lines else 0,
                np.log1p(n / max(1, len(lines))),
            )
    return out


@dataclass
class Model:
    """Bin edges and lookup tables; ``base`` is the log odds of the labels."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def binned(self, x: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        return np.stack(columns, axis=1) if columns else np.zeros((len(x), 0), np.int64)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (i, j), table in self.pairs.items():
            total += table[bins[:, i], bins[:, j]]
        return total

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(features(texts))))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _leaf(g: float, h: float) -> float:
    return STEP * g / (h + RIDGE)


def _line_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bin values of the best tree of at most three leaves over one feature's bins."""
    cuts: list[int] = []
    for _ in range(2):
        best, where = 1e-9, None
        for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True):
            if b - a < 2:
                continue
            left_g, left_h, left_n = (np.cumsum(v[a:b])[:-1] for v in (g, h, n))
            all_g, all_h, all_n = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h)
            gains = gains - _gain(all_g, all_h)
            gains[(left_n < LEAF) | (all_n - left_n < LEAF)] = 0
            k = int(gains.argmax())
            if gains[k] > best:
                best, where = gains[k], a + k + 1
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.empty(len(g))
    for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best one-cut-per-axis tree over a pair's bins."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gains = np.zeros((g.shape[0] - 1, g.shape[1] - 1))
    for c, d in ((cg, ch),):
        a_g, a_h = c[:-1, :-1], d[:-1, :-1]
        b_g, b_h = c[:-1, -1:] - a_g, d[:-1, -1:] - a_h
        c_g, c_h = c[-1:, :-1] - a_g, d[-1:, :-1] - a_h
        d_g, d_h = c[-1, -1] - a_g - b_g - c_g, d[-1, -1] - a_h - b_h - c_h
        gains = _gain(a_g, a_h) + _gain(b_g, b_h) + _gain(c_g, c_h) + _gain(d_g, d_h)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.empty_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables on labelled rows (y in 0, 1)."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(base=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    marks = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, j], marks)) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = model.binned(x)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            if len(table) < 2:
                continue
            g, h = slopes()
            k = bins[:, j]
            value = _line_tree(
                np.bincount(k, g, len(table)), np.bincount(k, h, len(table)),
                np.bincount(k, minlength=len(table)),
            )
            table += value
            total += value[k]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(model.tables[i]), len(model.tables[j])
        k = bins[:, i] * shape[1] + bins[:, j]
        g, h = slopes()
        return (
            k, np.bincount(k, g, shape[0] * shape[1]).reshape(shape),
            np.bincount(k, h, shape[0] * shape[1]).reshape(shape),
        )

    wide = [j for j, t in enumerate(model.tables) if len(t) > 1]
    gains = sorted(
        ((_quadrants(*cells(i, j)[1:])[0], i, j) for i, j in combinations(wide, 2)), reverse=True
    )
    for _, i, j in gains[:PAIRS]:
        model.pairs[i, j] = np.zeros((len(model.tables[i]), len(model.tables[j])))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            k, g, h = cells(i, j)
            value = _quadrants(g, h)[1]
            table += value
            total += value.ravel()[k]
    return model


def sample(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, label): at most ``rows`` labelled ids, those of smallest hash."""
    known = labels.where("doc_id is not null and quality is not null")
    return (
        known.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "label")
        .limit(rows)
    )


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on the sampled labelled rows; only their feature vectors reach the driver.

    The sampled ids are broadcast: at most ``rows`` of 12 bytes.
    """
    as_array = F.pandas_udf(_feature_rows, "array<double>")
    few = sample(labels, rows)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(few), "doc_id")
    got = texts.select("doc_id", "label", as_array("text").alias("x")).toPandas()
    if not len(got):
        return Model()
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort((*x.T, got["label"], got["doc_id"]))  # task order must not matter
    return fit(x[order], got["label"].to_numpy(float)[order])


def _feature_rows(text: pd.Series) -> pd.Series:
    return pd.Series(list(features(text.tolist())))


def scorer(model: Model) -> Callable[[Column | str], Column]:
    """Column function: the score (0 to 1) of a text column."""

    def run(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(text.tolist()))

    return F.pandas_udf(run, "double")


def accepted(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """Documents scored at least ``least``, with their columns as they came."""
    return docs.where(scorer(model)("text") >= least)
