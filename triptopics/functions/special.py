"""Vectorised digamma and log-gamma for positive arguments, in NumPy and as Spark columns.

Both use the upward recurrence until the argument is at least 8 and then
the standard asymptotic (Stirling / de Moivre) series; the error is below
1e-12 for every x > 0, which is far tighter than the variational updates
need.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT_TO = 8.0
_HALF_LOG_2PI = 0.5 * np.log(2.0 * np.pi)


def _shifted(x) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, int]:
    """The arguments moved up to at least 8: (moved, mask of the moved ones or None, their old values, steps of the recurrence)."""
    x = np.asarray(x, dtype=np.float64)
    small = x < _SHIFT_TO
    if not small.any():
        return x, None, x, 0
    low = x[small]
    steps = int(np.ceil(_SHIFT_TO - low.min()))
    return np.where(small, x + steps, x), small, low, steps


def _digamma_series(inv: np.ndarray) -> np.ndarray:
    inv2 = inv * inv
    return 0.5 * inv + inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252 - inv2 * (
        1.0 / 240 - inv2 * (1.0 / 132)))))


def _gammaln_series(inv: np.ndarray) -> np.ndarray:
    inv2 = inv * inv
    return inv * (1.0 / 12 - inv2 * (1.0 / 360 - inv2 * (1.0 / 1260 - inv2 * (1.0 / 1680))))


def digamma(x) -> np.ndarray:
    y, small, low, steps = _shifted(x)
    out = np.asarray(np.log(y) - _digamma_series(1.0 / y))
    if small is not None:
        out[small] -= sum(1.0 / (low + k) for k in range(steps))
    return out


def gammaln(x) -> np.ndarray:
    y, small, low, steps = _shifted(x)
    out = np.asarray((y - 0.5) * np.log(y) - y + _HALF_LOG_2PI + _gammaln_series(1.0 / y))
    if small is not None:
        out[small] -= np.log(np.prod([low + k for k in range(steps)], axis=0))
    return out


def digamma_gammaln(x) -> tuple[np.ndarray, np.ndarray]:
    """Both functions of the same arguments, with their shift, logarithm and inverse taken once."""
    y, small, low, steps = _shifted(x)
    log, inv = np.log(y), 1.0 / y
    psi, ln = log - _digamma_series(inv), (y - 0.5) * log - y + _HALF_LOG_2PI + _gammaln_series(inv)
    if small is not None:
        product, slope = low.copy(), 1.0 / low
        for k in range(1, steps):
            product *= low + k
            slope += 1.0 / (low + k)
        psi[small] -= slope
        ln[small] -= np.log(product)
    return psi, ln


# ---- the same functions as Spark columns --------------------------------------------------------

_COLUMN_SHIFT = 8


def _col_series(inv: Column, terms: tuple[float, ...]) -> Column:
    """t0 − inv²(t1 − inv²(t2 − ...))."""
    out = F.lit(terms[-1])
    for t in reversed(terms[:-1]):
        out = F.lit(t) - inv * inv * out
    return out


def digamma_col(x: Column) -> Column:
    """Digamma of a positive column: eight steps of the recurrence, then the asymptotic series."""
    y = x + _COLUMN_SHIFT
    inv = F.lit(1.0) / y
    steps = sum((F.lit(1.0) / (x + k) for k in range(1, _COLUMN_SHIFT)), F.lit(1.0) / x)
    return F.log(y) - inv * 0.5 - inv * inv * _col_series(inv, (1 / 12, 1 / 120, 1 / 252, 1 / 240, 1 / 132)) - steps


def gammaln_col(x: Column) -> Column:
    """Log-gamma of a positive column, by the same two steps."""
    y = x + _COLUMN_SHIFT
    inv = F.lit(1.0) / y
    steps = sum((F.log(x + k) for k in range(1, _COLUMN_SHIFT)), F.log(x))
    return (y - 0.5) * F.log(y) - y + float(_HALF_LOG_2PI) + inv * _col_series(inv, (1 / 12, 1 / 360, 1 / 1260, 1 / 1680)) - steps
