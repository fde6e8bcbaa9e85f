"""Linear support vector machine with squared hinge loss, over sparse rows.

Primal Newton: with the rows inside the margin fixed, the loss is a quadratic, whose system is
solved by conjugate gradients. Each step needs one product of the curvature with a vector, which
is a sum over sparse rows (``passes.added``); neither a Gram matrix nor dense rows are formed. The
fit on all rows and one fit per held-out fold advance in the same passes.

Minimised is ``|w|^2 / 2 + cost * sum(max(0, 1 - y f)^2)``, y being -1 or 1; the bias is a weight of
a constant column and so is part of ``w``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from clonoframe.operators.passes import added

NEWTON, CONJUGATE = 50, 200  # steps at most
TOLERANCE = 1e-8


class _Sparse:
    """One batch of rows (label, fold, keys, values) as flat arrays, a constant column last."""

    def __init__(self, batch: pa.RecordBatch, ids: np.ndarray) -> None:
        keys, values = batch.column("keys"), batch.column("values")
        width = np.diff(keys.offsets.to_numpy())
        self.n = batch.num_rows
        self.row = np.concatenate([np.repeat(np.arange(self.n), width), np.arange(self.n)])
        at = np.searchsorted(ids, keys.flatten().to_numpy())
        self.at = np.concatenate([at, np.full(self.n, len(ids))])
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
        self.values = np.concatenate([flat, np.ones(self.n)])
        self.y = np.where(batch.column("label").to_numpy(zero_copy_only=False).astype(float) > 0, 1.0, -1.0)
        self.fold = batch.column("fold").to_numpy(zero_copy_only=False).astype(int)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.at], self.n)

    def back(self, v: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, self.values * v[self.row], size)


class MarginFit:
    """``weights`` (1 + folds, columns + 1), bias last; model 0 learns from all rows."""

    def __init__(self, rows: DataFrame, ids: Sequence[int], cost: float = 0.1, n_folds: int = 0) -> None:
        """``rows``: (label 0/1, fold, keys array<long>, values array<double>), staged; keys are ids."""
        self.rows = rows.select("label", "fold", "keys", "values")
        self.ids, self.cost = np.sort(np.asarray(ids, np.int64)), cost
        self.size, self.models = len(self.ids) + 1, n_folds + 1
        self.weights = np.zeros((self.models, self.size))
        self._fit()

    def _sums(self, w: np.ndarray, direction: np.ndarray | None) -> np.ndarray:
        """Per model the loss and its slope at w, or the curvature there times a direction."""
        ids, size, models = self.ids, self.size, self.models

        def sums(batch: pa.RecordBatch) -> np.ndarray:
            x = _Sparse(batch, ids)
            out = np.zeros((models, size + 1))
            for m in range(models):
                slack = (1 - x.y * x.times(w[m])) * (x.fold != m - 1)
                inside = slack > 0
                if direction is None:
                    slack = np.where(inside, slack, 0.0)
                    out[m, 0] = slack @ slack
                    out[m, 1:] = x.back(-x.y * slack, size)
                else:
                    out[m, 1:] = x.back(np.where(inside, x.times(direction[m]), 0.0), size)
            return out.ravel()

        return added(self.rows, sums).reshape(models, size + 1)

    def _price(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self._sums(w, None)
        return (w**2).sum(axis=1) / 2 + self.cost * found[:, 0], w + 2 * self.cost * found[:, 1:]

    def _fit(self) -> None:
        w = self.weights
        price, slope = self._price(w)
        first = np.linalg.norm(slope, axis=1)
        for _ in range(NEWTON):
            if (np.linalg.norm(slope, axis=1) <= TOLERANCE * np.maximum(first, 1e-300)).all():
                break
            # conjugate gradients on (1 + 2 cost X'X) step = -slope, all models abreast
            step, rest = np.zeros_like(w), -slope
            way, size = rest.copy(), (rest**2).sum(axis=1)
            goal = size * 1e-12
            for _ in range(min(CONJUGATE, 2 * self.size)):
                if (size <= goal).all():
                    break
                curved = way + 2 * self.cost * self._sums(w, way)[:, 1:]
                bend = (way * curved).sum(axis=1)
                go = np.where((size > goal) & (bend > 0), size / np.where(bend > 0, bend, 1), 0)
                step += go[:, None] * way
                rest = rest - go[:, None] * curved
                new = (rest**2).sum(axis=1)
                way = rest + np.where(size > goal, new / np.maximum(size, 1e-300), 0)[:, None] * way
                size = new
            length = np.ones(self.models)
            while True:  # a step that does not lower its price is halved
                price_new, slope_new = self._price(w + length[:, None] * step)
                worse = price_new > price + 1e-12 * np.maximum(1, price)
                if not worse.any() or length[worse].max() < 1e-6:
                    break
                length = np.where(worse, length / 2, length)
            w = w + length[:, None] * step
            price, slope = price_new, slope_new
        self.weights = w

    def table(self) -> DataFrame:
        """(fold, prototype, weight) of every held-out fold's fit (fold -1: all rows)."""
        fold, at = np.meshgrid(np.arange(-1, self.models - 1), np.arange(self.size - 1), indexing="ij")
        frame = pd.DataFrame(
            {"fold": fold.ravel(), "prototype": self.ids[at.ravel()], "weight": self.weights[:, :-1].ravel()}
        )
        return self.rows.sparkSession.createDataFrame(frame, "fold int, prototype long, weight double")
