"""Tail probabilities Spark has no built-in for: one vectorised call per batch of tests.

Rows are tests (features, k-mers, prototypes), never observations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT_LIMIT = 50
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def rank_sum_exact(n_in: int, rank_sum: float, ties: list[int]) -> float:
    """Two-sided conditional p of a rank sum over mid-ranks, by counting subsets.

    ``ties`` holds tie-block sizes in value order. Doubled mid-ranks are integers, so the
    subset-sum distribution is an exact integer table.
    """
    doubled, below = [], 0
    for size in ties:
        doubled += [2 * below + size + 1] * size
        below += size
    total = sum(doubled)
    ways = np.zeros((n_in + 1, total + 1))
    ways[0, 0] = 1.0
    for rank in doubled:
        ways[1:, rank:] += ways[:-1, : total + 1 - rank].copy()
    weights = ways[n_in] / ways[n_in].sum()
    gap = abs(2 * rank_sum - n_in * total / below)
    away = np.abs(np.arange(total + 1) - n_in * total / below)
    return float(min(1.0, weights[away >= gap - 1e-6].sum()))


def rank_sum_normal(n_in: int, n_out: int, u: float, tie_term: float) -> float:
    """Two-sided normal approximation with tie and continuity correction."""
    n = n_in + n_out
    spread = n_in * n_out / 12.0 * ((n + 1) - tie_term / (n * (n - 1.0)))
    if spread <= 0:
        return 1.0
    z = max(0.0, abs(u - n_in * n_out / 2.0) - 0.5) / math.sqrt(spread)
    return math.erfc(z / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def rank_sum_p(
    n_in: pd.Series, n_out: pd.Series, u: pd.Series, tie_term: pd.Series, ties: pd.Series
) -> pd.Series:
    def one(a, b, stat, term, blocks):
        if not a or not b or math.isnan(stat):
            return None
        a, b = int(a), int(b)
        if a < EXACT_LIMIT and b < EXACT_LIMIT:
            return rank_sum_exact(a, stat + a * (a + 1) / 2.0, [int(t) for t in blocks])
        return rank_sum_normal(a, b, stat, term)

    return pd.Series([one(*row) for row in zip(n_in, n_out, u, tie_term, ties)], dtype="float64")


def _stirling_error(n: float) -> float:
    """ln n! minus Stirling's leading terms."""
    if n <= 15:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - _HALF_LOG_2PI if n else 0.0
    s = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / s) / s) / s) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x/mean) + mean - x, by series when x is near the mean."""
    gap = x - mean
    if abs(gap) < 0.1 * (x + mean):
        v = gap / (x + mean)
        total, term, k = gap * v, 2 * x * v, 1
        while True:
            term *= v * v
            grown = total + term / (2 * k + 1)
            if grown == total:
                return total
            total, k = grown, k + 1
    return x * math.log(x / mean) + mean - x


def _log_binomial(x: float, n: float, p: float) -> float:
    """Log binomial mass by saddle-point expansion; keeps precision for huge n."""
    if x == 0:
        return n * math.log1p(-p) if n else 0.0
    if x == n:
        return n * math.log(p)
    core = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
    core -= _deviance(x, n * p) + _deviance(n - x, n * (1 - p))
    return core - 0.5 * math.log(2 * math.pi * x * (n - x) / n)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of hypergeometric masses not above the observed one.

    The mass is unimodal, so the far side starts where a binary search finds the first
    mass at or below the observed one, and each tail is a short ratio recurrence.
    """
    rows, cols, n = a + b, a + c, a + b + c + d
    low, high = max(0, rows + cols - n), min(rows, cols)
    if low == high:
        return 1.0
    p = cols / n

    def log_mass(x: int) -> float:
        return (
            _log_binomial(x, rows, p)
            + _log_binomial(cols - x, n - rows, p)
            - _log_binomial(cols, n, p)
        )

    if n == rows or p in (0.0, 1.0):
        return 1.0
    seen = log_mass(a)
    bar = seen + 1e-7
    mode = min(high, max(low, (rows + 1) * (cols + 1) // (n + 2)))

    def tail(start: int, step: int) -> float:
        if start < low or start > high:
            return 0.0
        mass = math.exp(log_mass(start))
        total, x = mass, start
        while low <= x + step <= high and mass > total * 1e-17:
            if step > 0:
                mass *= (rows - x) * (cols - x) / ((x + 1) * (n - rows - cols + x + 1))
            else:
                mass *= x * (n - rows - cols + x) / ((rows - x + 1) * (cols - x + 1))
            total, x = total + mass, x + step
        return total

    if log_mass(mode) <= bar:  # the observed cell shares the mode: no table is likelier
        return 1.0
    if a >= mode:
        left, right = low - 1, mode
        while right - left > 1:
            mid = (left + right) // 2
            left, right = (mid, right) if log_mass(mid) <= bar else (left, mid)
        return min(1.0, tail(a, 1) + tail(left, -1))
    left, right = mode, high + 1
    while right - left > 1:
        mid = (left + right) // 2
        left, right = (left, mid) if log_mass(mid) <= bar else (mid, right)
    return min(1.0, tail(a, -1) + tail(right, 1))


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(
        [fisher_two_sided(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)],
        dtype="float64",
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_two_sided(rho: float, n: int) -> float:
    """Two-sided t-test p of a correlation over n pairs."""
    if n < 3 or math.isnan(rho):
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    t2 = rho * rho * df / (1 - rho * rho)
    return beta_tail(df / 2.0, 0.5, df / (df + t2))


@F.pandas_udf(T.DoubleType())
def correlation_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(
        [correlation_two_sided(float(r), int(k)) for r, k in zip(rho, n)], dtype="float64"
    )
