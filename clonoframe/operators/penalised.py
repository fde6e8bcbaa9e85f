"""Penalised logistic regression over a whole path of penalties, cross-validated in one go.

All models of a block of penalties, the fit on all rows and one fit per held-out fold, advance
together: one pass over the rows adds up, per model, the gradient and the weighted Gram matrix of
its quadratic approximation, and coordinate descent solves the penalised problems on those sums.
A block starts from the last solution of the block before it. Rows are standardised per training
set, whose means and deviations are the totals minus the held-out fold, so folds cost no extra
pass. The sums of a task are added up in a tree; what reaches the driver is a Gram matrix per
model, so tables may have some hundreds of columns and any number of rows.

Two classes use the logistic loss, more the softmax loss with the curvature between classes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoframe.operators.passes import added

BLOCK = 10  # penalties that advance together, fewer when their sums exceed CELLS numbers
CELLS = 1 << 21
PASSES = 60  # over the rows, per block, at most
SWEEPS = 1000
TOLERANCE = 1e-7
EDGE = 1e-5  # least curvature of a row


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, batch.column("label").to_numpy().astype(int), batch.column("fold").to_numpy().astype(int)


def _added(rows: DataFrame, sums) -> np.ndarray:
    return added(rows, lambda batch: sums(*_read(batch)))


@dataclass
class Moments:
    """Count, class counts, means and deviations of every training set (fold -1: all rows)."""

    n: np.ndarray  # (sets,)
    classes: np.ndarray  # (sets, classes)
    mean: np.ndarray  # (sets, p)
    sd: np.ndarray  # (sets, p); 1 where a column is constant
    cross: np.ndarray  # (classes, p) sums of x by class over all rows


def moments(rows: DataFrame, p: int, n_classes: int, n_folds: int) -> Moments:
    def sums(x: np.ndarray, label: np.ndarray, fold: np.ndarray) -> np.ndarray:
        cell = np.eye(n_folds * n_classes)[fold * n_classes + label].T
        return np.concatenate([cell.sum(axis=1)[:, None], cell @ x, cell @ (x * x)], axis=1).ravel()

    by_cell = _added(rows, sums).reshape(n_folds, n_classes, 1 + 2 * p)
    total = by_cell.sum(axis=0)
    # a training set is everything but its fold
    sets = np.concatenate([total[None], total[None] - by_cell])
    flat = sets.sum(axis=1)
    n = flat[:, 0]
    mean = flat[:, 1 : 1 + p] / n[:, None]
    variance = np.maximum(flat[:, 1 + p :] / n[:, None] - mean**2, 0)
    sd = np.sqrt(variance)
    small = sd <= 1e-12 * np.maximum(1, np.abs(mean))
    return Moments(n, sets[:, :, 0], mean, np.where(small, 1.0, sd), total[:, 1 : 1 + p])


def _probability(eta: np.ndarray) -> np.ndarray:
    """(rows, models, outcomes) probabilities from linear scores; one outcome means two classes."""
    if eta.shape[2] == 1:
        return 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
    shifted = np.exp(eta - eta.max(axis=2, keepdims=True))
    return shifted / shifted.sum(axis=2, keepdims=True)


def _loss(eta: np.ndarray, label: np.ndarray) -> np.ndarray:
    if eta.shape[2] == 1:
        e = eta[:, :, 0]
        return np.logaddexp(0, e) - label[:, None] * e
    top = eta.max(axis=2)
    whole = top + np.log(np.exp(eta - top[:, :, None]).sum(axis=2))
    return whole - np.take_along_axis(eta, label[:, None, None], axis=2)[:, :, 0]


def _called(eta: np.ndarray) -> np.ndarray:
    return (eta[:, :, 0] > 0).astype(int) if eta.shape[2] == 1 else eta.argmax(axis=2)


def _pass(rows: DataFrame, weight: np.ndarray, held_out: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of all models at their weights (models, outcomes, 1 + p, raw scale, intercept first).

    Gradient and Gram over training rows, the training loss, and loss and errors over the
    rows of the held-out fold.
    """
    m, k, q = weight.shape

    def sums(x: np.ndarray, label: np.ndarray, fold: np.ndarray) -> np.ndarray:
        z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        eta = np.einsum("np,mkp->nmk", z, weight, optimize=True)
        probability = _probability(eta)
        target = label[:, None] == (np.arange(k)[None, :] if k > 1 else [[1]])
        train = (fold[:, None] != held_out[None, :]).astype(float)
        pull = (target[:, None, :] - probability) * train[:, :, None]
        gram = np.zeros((m, k, q, k, q))
        for i in range(m):
            of = probability[:, i]
            for a in range(k):
                for b in range(a, k):
                    w = np.maximum(of[:, a] * (1 - of[:, a]), EDGE) if a == b else -of[:, a] * of[:, b]
                    gram[i, a, :, b] = (z * (w * train[:, i])[:, None]).T @ z
                    gram[i, b, :, a] = gram[i, a, :, b].T
        loss = _loss(eta, label)
        wrong = (_called(eta) != label[:, None]) * (1 - train)
        return np.concatenate([
            np.einsum("nmk,np->mkp", pull, z, optimize=True).ravel(), gram.ravel(),
            (loss * train).sum(axis=0), (loss * (1 - train)).sum(axis=0), wrong.sum(axis=0),
        ])

    flat = _added(rows, sums)
    sizes = np.cumsum([m * k * q, (m * k * q) * k * q, m, m])
    pull, gram, loss, held_loss, errors = np.split(flat, sizes)
    return pull.reshape(m, k, q), gram.reshape(m, k, q, k, q), loss, held_loss, errors


def descend(
    beta: np.ndarray, pull: np.ndarray, gram: np.ndarray, l1: np.ndarray, l2: np.ndarray
) -> np.ndarray:
    """Minimise the penalised quadratic models by cyclic coordinate descent, all models abreast.

    ``pull`` and ``gram`` (models, q[, q]) are gradient and curvature at ``beta``; penalties are
    (models, q).
    """
    new, slope = beta.copy(), pull.copy()
    curve = np.maximum(np.einsum("mii->mi", gram), 0)
    for _ in range(SWEEPS):
        most = 0.0
        for j in range(beta.shape[1]):
            free = slope[:, j] + curve[:, j] * new[:, j]
            at = np.sign(free) * np.maximum(np.abs(free) - l1[:, j], 0) / np.maximum(curve[:, j] + l2[:, j], 1e-300)
            step = at - new[:, j]
            if step.any():
                slope -= gram[:, :, j] * step[:, None]
                new[:, j] = at
                most = max(most, float(np.max(np.abs(step) * np.sqrt(curve[:, j]))))
        if most < TOLERANCE * 0.1:
            break
    return new


class Path:
    """Weights of every penalty and training set, and the held-out curve."""

    def __init__(
        self, rows: DataFrame, p: int, n_classes: int, n_folds: int, alpha: float = 1.0,
        n_lambda: int = 100, ratio: float | None = None, lambdas: Sequence[float] | None = None,
    ) -> None:
        """``rows``: (x array<double>, label double or int, fold int), checkpointed."""
        self.rows, self.alpha, self.n_folds = rows, alpha, n_folds
        self.outcomes = 1 if n_classes == 2 else n_classes
        self.moments = m = moments(rows, p, n_classes, n_folds)
        share = m.classes / m.n[:, None]
        if lambdas is None:
            z = (m.cross - m.classes[0][:, None] * m.mean[0]) / m.sd[0]
            top = np.abs(z).max() / m.n[0] / max(alpha, 1e-3)
            ratio = ratio or (1e-4 if m.n[0] > p else 1e-2)
            lambdas = top * ratio ** (np.arange(n_lambda) / max(1, n_lambda - 1))
        self.lambdas = np.asarray(lambdas, float)
        sets = n_folds + 1
        # (penalties, sets, outcomes, 1 + p), standardised scale
        self.beta = np.zeros((len(self.lambdas), sets, self.outcomes, 1 + p))
        self.held_loss = np.zeros((len(self.lambdas), sets))
        self.errors = np.zeros((len(self.lambdas), sets))
        held = np.clip(share, 1e-9, 1 - 1e-9)
        start = np.zeros((sets, self.outcomes, 1 + p))
        start[:, :, 0] = np.log(held[:, 1:2] / held[:, :1]) if self.outcomes == 1 else np.log(held)
        block = max(1, min(BLOCK, CELLS // (sets * (self.outcomes * (1 + p)) ** 2)))
        for a in range(0, len(self.lambdas), block):
            start = self._block(slice(a, a + block), start)

    def raw(self, beta: np.ndarray) -> np.ndarray:
        """Weights for unscaled columns; the axis before the outcomes numbers the training sets."""
        sd, mean = self.moments.sd[:, None, :], self.moments.mean[:, None, :]
        out = beta.copy()
        out[..., 1:] /= sd
        out[..., 0] -= (out[..., 1:] * mean).sum(axis=-1)
        return out

    def _block(self, part: slice, start: np.ndarray) -> np.ndarray:
        lambdas = self.lambdas[part]
        b, (sets, k, q) = len(lambdas), start.shape
        m = b * sets
        beta = np.broadcast_to(start, (b, sets, k, q)).copy()
        n = np.tile(self.moments.n, b)
        l1 = np.repeat(lambdas, sets) * self.alpha * n
        l2 = np.repeat(lambdas, sets) * (1 - self.alpha) * n
        free = np.concatenate([[0.0], np.ones(q - 1)])  # the intercept is not penalised
        held_out = np.tile(np.arange(-1, sets - 1), b)
        # from raw rows (1, x) to standardised ones: z = scale @ (1, x)
        scale = np.zeros((sets, q, q))
        scale[:, 0, 0] = 1
        scale[:, 1:, 0] = -self.moments.mean / self.moments.sd
        scale[:, np.arange(1, q), np.arange(1, q)] = 1 / self.moments.sd
        scale = np.tile(scale, (b, 1, 1))
        before = beta.copy()
        best = np.full(m, np.inf)
        for _ in range(PASSES):
            weight = self.raw(beta).reshape(m, k, q)
            pull, gram, loss, held_loss, errors = _pass(self.rows, weight, held_out)
            flat = beta.reshape(m, k, q)
            price = (l1[:, None] * np.abs(flat[:, :, 1:]).sum(axis=2) + l2[:, None] / 2 * (flat[:, :, 1:] ** 2).sum(axis=2)).sum(axis=1)
            worse = loss + price > best * (1 + 1e-12) + 1e-9
            best = np.where(worse, best, loss + price)
            pull = np.einsum("mqp,mkp->mkq", scale, pull)
            gram = np.einsum("mqp,mkplr,msr->mkqls", scale, gram, scale, optimize=True)
            new = descend(
                flat.reshape(m, k * q), pull.reshape(m, k * q), gram.reshape(m, k * q, k * q),
                l1[:, None] * np.tile(free, k), l2[:, None] * np.tile(free, k),
            ).reshape(m, k, q)
            # a step that made its objective worse is halved
            back = before.reshape(m, k, q)
            new = np.where(worse[:, None, None], (flat + back) / 2, new)
            moved = np.abs(new - flat).max()
            before = np.where(worse[:, None, None], back, flat).reshape(beta.shape).copy()
            beta = new.reshape(beta.shape)
            if moved < TOLERANCE * max(1.0, np.abs(new).max()):
                break
        self.beta[part] = beta
        self.held_loss[part] = held_loss.reshape(b, sets)
        self.errors[part] = errors.reshape(b, sets)
        return beta[-1]

    def curve(self, spark) -> DataFrame:
        """Per penalty the held-out error and deviance, their errors over folds, columns used."""
        n = self.moments.n[0] - self.moments.n[1:]
        used = n > 0
        share = n[used] / n.sum()

        def folded(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            each = sums[:, 1:][:, used] / n[used]
            mean = each @ share
            return mean, np.sqrt(((each - mean[:, None]) ** 2) @ share / max(1, used.sum() - 1))

        error, error_se = folded(self.errors)
        deviance, deviance_se = folded(2 * self.held_loss)
        nonzero = (self.beta[:, 0, :, 1:] != 0).any(axis=1).sum(axis=1)
        table = pd.DataFrame(
            {"step": np.arange(len(error)), "lambda": self.lambdas, "error": error, "error_se": error_se,
             "deviance": deviance, "deviance_se": deviance_se, "n_nonzero": nonzero}
        )
        return spark.createDataFrame(
            table, "step int, lambda double, error double, error_se double, deviance double,"
            " deviance_se double, n_nonzero int",
        )

    def best_step(self, measure: str = "error") -> int:
        """The penalty of least held-out error; the larger penalty wins a tie."""
        sums = self.errors if measure == "error" else self.held_loss
        return int(np.argmin(sums[:, 1:].sum(axis=1)))

    def weights(self, spark, columns: Sequence[str], classes: Sequence[str]) -> DataFrame:
        """(step, lambda, class, feature, weight) of the fits on all rows, standardised scale."""
        names = list(classes[1:]) if self.outcomes == 1 else list(classes)
        step, name, feature = np.meshgrid(np.arange(len(self.lambdas)), names, columns, indexing="ij")
        table = pd.DataFrame(
            {"step": step.ravel(), "lambda": self.lambdas[step.ravel()], "class": name.ravel(),
             "feature": feature.ravel(), "weight": self.beta[:, 0, :, 1:].ravel()}
        )
        return spark.createDataFrame(table, "step int, lambda double, class string, feature string, weight double")

    def predictions(self, rows: DataFrame, step: int, held_out: bool = True) -> DataFrame:
        """(…, prediction, score) of rows (x, fold, …) by the fit that did not see their fold."""
        weight = self.raw(self.beta[step])
        kept = [c for c in rows.columns if c != "x"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                z = np.concatenate([np.ones((len(batch), 1)), np.stack(batch["x"])], axis=1)
                own = weight[batch["fold"].to_numpy() + 1] if held_out else np.broadcast_to(weight[0], (len(z), *weight[0].shape))
                eta = np.einsum("np,nkp->nk", z, own)[:, None, :]
                out = batch[kept].copy()
                out["prediction"] = _called(eta)[:, 0].astype(float)
                p = _probability(eta)[:, 0]
                out["score"] = p[:, 0] if p.shape[1] == 1 else None
                yield out

        schema = rows.select(*kept, F.lit(0.0).alias("prediction"), F.lit(None).cast("double").alias("score")).schema
        return rows.mapInPandas(run, schema)


def as_rows(folded: DataFrame) -> DataFrame:
    """Rows of a prepared table (vector ``x``, ``label``, ``fold``) as the path reads them."""
    return folded.select(
        vector_to_array("x").alias("x"), F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"),
        *[c for c in folded.columns if c not in ("x", "label", "fold")],
    )
