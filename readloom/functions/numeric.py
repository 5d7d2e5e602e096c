"""Distribution tails without SciPy: vectorised over numpy arrays, and as pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Lanczos coefficients (g = 7, n = 9) of the gamma function.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of gamma for positive x."""
    x = np.asarray(x, dtype=float) - 1.0
    total = np.full_like(x, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def beta_tail(a, b, x) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, for arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.clip(np.where(turned, 1 - x, x), 0.0, 1.0)
    inside = (y > 0) & (y < 1)
    safe = np.where(inside, y, 0.5)
    with np.errstate(all="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(safe) + q * np.log1p(-safe)) / p
        guard = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
        c, d = np.ones_like(safe), 1.0 / guard(1.0 - (p + q) * safe / (p + 1))
        f = d.copy()
        for m in range(1, 400):
            for top in (m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * safe / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1.0 / guard(1.0 + top * d), guard(1.0 + top / c)
                f = f * c * d
            if np.all(np.abs(c * d - 1.0) < 1e-14):
                break
    low = np.where(inside, front * f, np.where(y <= 0, 0.0, 1.0))
    return np.where(turned, 1.0 - low, low)


def gamma_tail(a, x) -> np.ndarray:
    """Upper regularised incomplete gamma for arrays: a series below a + 1, a continued fraction above."""
    a, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, x))
    safe, below = np.where(x > 0, x, 1.0), x < a + 1
    with np.errstate(all="ignore"):
        front = np.exp(-safe + a * np.log(safe) - lgamma(a))
        term = 1.0 / a
        total = term.copy()
        for n in range(1, 100_000):
            term = term * safe / (a + n)
            total = total + np.where(below, term, 0.0)
            if not np.any(below & (term >= total * 1e-16)):
                break
        b, c = safe + 1 - a, np.full_like(safe, 1e300)
        d = 1.0 / np.where(np.abs(b) > 1e-300, b, 1e-300)
        f = d.copy()
        for i in range(1, 2000):
            top, b = -i * (i - a), b + 2
            d, c = 1.0 / (top * d + b), b + top / c
            f = f * np.where(below, 1.0, c * d)
            if not np.any(~below & (np.abs(c * d - 1.0) >= 1e-15)):
                break
    return np.where(x <= 0, 1.0, np.where(below, 1.0 - front * total, front * f))


def t_two_sided(t, df) -> np.ndarray:
    t, df = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(t, df))
    known = (df > 0) & ~np.isnan(t)
    square, d = np.where(known & np.isfinite(t), t * t, 0.0), np.where(known, df, 1.0)
    return np.where(known, np.where(np.isinf(t), 0.0, beta_tail(d / 2, 0.5, d / (d + square))), np.nan)


def chi_square_upper(x, df) -> np.ndarray:
    x, df = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(x, df))
    known = (df > 0) & ~np.isnan(x)
    return np.where(known, gamma_tail(np.where(known, df, 1.0) / 2, np.where(known, x, 0.0) / 2), np.nan)


def poisson_upper(k, mean) -> np.ndarray:
    """P(X >= k) of a Poisson variable."""
    k, mean = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(k, mean))
    known = ~np.isnan(k) & ~np.isnan(mean)
    tail = 1.0 - gamma_tail(np.where(known & (k > 0), k, 1.0), np.where(known & (mean > 0), mean, 0.0))
    return np.where(known, np.where(k <= 0, 1.0, np.where(mean <= 0, 0.0, tail)), np.nan)


class _Tables:
    """2x2 tables with given margins: log probabilities by the first cell."""

    def __init__(self, a, b, c, d):
        self.row, self.column, self.n = a + b, a + c, a + b + c + d
        self.low, self.high = np.maximum(0.0, self.row + self.column - self.n), np.minimum(self.row, self.column)
        f = lambda v: lgamma(v + 1)
        self.base = f(self.row) + f(self.n - self.row) + f(self.column) + f(self.n - self.column) - f(self.n)
        mode = np.floor((self.row + 1) * (self.column + 1) / (self.n + 2))
        self.mode = np.clip(mode, self.low, self.high)

    def log(self, x: np.ndarray) -> np.ndarray:
        """Of cells ``x`` (rows, or rows by places); minus infinity outside."""
        side = (lambda v: v[:, None]) if x.ndim == 2 else (lambda v: v)
        row, column, n, low, high = map(side, (self.row, self.column, self.n, self.low, self.high))
        inside = (x >= low) & (x <= high)
        x = np.where(inside, x, low)
        f = lambda v: lgamma(v + 1)
        return np.where(inside, side(self.base) - f(x) - f(row - x) - f(column - x) - f(n - row - column + x), -np.inf)

    def tail(self, start: np.ndarray, step: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Sum of probabilities from ``start`` outwards until they no longer count."""
        total, at, active = np.zeros(len(start)), start.astype(float), active.copy()
        width = 64
        while active.any():
            terms = np.exp(self.log(at[:, None] + step[:, None] * np.arange(width)))
            total += np.where(active, terms.sum(axis=1), 0.0)
            active &= terms[:, -1] > total * 1e-18
            at = at + step * width
            width = min(width * 2, 1024)
        return total


def _counts(*cells) -> tuple[list[np.ndarray], np.ndarray]:
    """Cells as arrays of whole numbers, and which tables are known; unknown ones are of zeros."""
    cells = [np.atleast_1d(np.asarray(v, dtype=float)) for v in np.broadcast_arrays(*cells)]
    known = np.all([~np.isnan(v) & (v >= 0) for v in cells], axis=0)
    return [np.floor(np.where(known, v, 0.0)) for v in cells], known


def fisher_two_sided(a, b, c, d) -> np.ndarray:
    """Probability of all tables that are no more likely, for arrays; NaN for negative or unknown counts.

    Both tails are summed outwards from where tables are as unlikely as this one; the other tail's
    begin is found by bisection, as probabilities fall away from the mode on each side.
    """
    (a, b, c, d), known = _counts(a, b, c, d)
    t = _Tables(a, b, c, d)
    seen, above = t.log(a) + 1e-7, a > t.mode
    # Outermost cell that is more likely than this one, on the other side of the mode.
    outside, inside = np.where(above, t.low - 1, t.high + 1), t.mode.copy()
    while (busy := np.abs(outside - inside) > 1).any():
        middle = np.where(busy, np.floor((outside + inside) / 2), inside)
        more = t.log(middle) > seen
        inside, outside = np.where(busy & more, middle, inside), np.where(busy & ~more, middle, outside)
    every = t.log(t.mode) <= seen
    own = t.tail(a, np.where(above, 1.0, -1.0), ~every)
    other = t.tail(outside, np.where(above, -1.0, 1.0), ~every & (t.log(outside) > -np.inf))
    out = np.where(known, np.where(every, 1.0, np.minimum(1.0, own + other)), np.nan)
    return out if out.size > 1 else out[0]


def fisher_greater(a, b, c, d) -> np.ndarray:
    """Probability of tables whose first cell is at least this one's."""
    (a, b, c, d), known = _counts(a, b, c, d)
    t = _Tables(a, b, c, d)
    upper = a > t.mode
    tail = t.tail(np.where(upper, a, a - 1), np.where(upper, 1.0, -1.0), np.where(upper, True, a - 1 >= t.low))
    out = np.where(known, np.minimum(1.0, np.where(upper, tail, 1.0 - tail)), np.nan)
    return out if out.size > 1 else out[0]


def fisher_r_by_2(first: list[int], second: list[int]) -> float:
    """Exact two-sided test of an r by 2 table: rows are convolved one by one.

    The probabilities of partial first-column sums are kept as a map from log probability, so
    that tables of many small rows stay exact; large tables grow with the product of margins.
    """
    pairs = [(int(a), int(b)) for a, b in zip(first, second) if a + b > 0]
    total, column = sum(a + b for a, b in pairs), sum(a for a, _ in pairs)
    if not pairs or column in (0, total):
        return 1.0
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    base = choose(total, column)
    seen = sum(choose(a + b, a) for a, b in pairs) - base
    layers: dict[int, dict[float, float]] = {0: {0.0: 1.0}}
    for a, b in pairs:
        nxt: dict[int, dict[float, float]] = {}
        for done, weights in layers.items():
            for k in range(min(a + b, column - done) + 1):
                into = nxt.setdefault(done + k, {})
                step = choose(a + b, k)
                for logp, times in weights.items():
                    key = round(logp + step, 9)
                    into[key] = into.get(key, 0.0) + times
        layers = nxt
    return float(min(1.0, sum(times * math.exp(p - base) for p, times in layers[column].items() if p - base <= seen + 1e-7)))


def _series(values: np.ndarray) -> pd.Series:
    return pd.Series(np.atleast_1d(values), dtype="float64")


@pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@pandas_udf(DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _series(chi_square_upper(x.to_numpy(float), df.to_numpy(float)))


@pandas_udf(DoubleType())
def poisson_p(k: pd.Series, mean: pd.Series) -> pd.Series:
    return _series(poisson_upper(k.to_numpy(float), mean.to_numpy(float)))


@pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _series(fisher_two_sided(*(v.to_numpy(float) for v in (a, b, c, d))))


@pandas_udf(DoubleType())
def gamma_tail_p(n: pd.Series, x: pd.Series) -> pd.Series:
    """Tail of a sum of n exponential values at x: the product of n uniform ones is at most exp(-x)."""
    return _series(np.where(n.to_numpy(float) > 0, gamma_tail(np.maximum(n.to_numpy(float), 1.0), x.to_numpy(float)), 1.0))


@pandas_udf(DoubleType())
def fisher_lesser_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Probability of tables whose first cell is at most this one's: those with the columns turned whose first is at least as great."""
    return _series(fisher_greater(*(v.to_numpy(float) for v in (b, a, d, c))))
