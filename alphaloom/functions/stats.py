"""Sample statistics and tail probabilities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sample_skew(x) -> Column:
    """Bias-adjusted skewness; null below three values."""
    x = _col(x)
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x) -> Column:
    """Bias-adjusted excess kurtosis; null below four values."""
    x = _col(x)
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when((n > 3) & (F.var_pop(x) > 0), ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def correlation(a, b, over=None) -> Column:
    """Pearson correlation of complete pairs, null when a side has no spread.

    ``F.corr`` raises on zero spread under ANSI arithmetic, so the quotient is formed here.
    ``over`` makes every part a window aggregate.
    """
    a, b = _col(a), _col(b)
    parts = [
        F.covar_pop(a, b),
        F.stddev_pop(F.when(b.isNotNull(), a)),
        F.stddev_pop(F.when(a.isNotNull(), b)),
    ]
    cov, sa, sb = parts if over is None else [p.over(over) for p in parts]
    return F.try_divide(cov, sa * sb)


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lg = np.vectorize(math.lgamma, otypes=[float])
    return lg(a) + lg(b) - lg(a + b)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b), element-wise."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    xs = np.clip(np.where(ok, x, 0.5), 0.0, 1.0)
    aa, bb = np.where(ok, a, 1.0), np.where(ok, b, 1.0)
    edge = (xs <= 0) | (xs >= 1)
    xi = np.where(edge, 0.5, xs)
    front = np.exp(aa * np.log(xi) + bb * np.log1p(-xi) - _log_beta(aa, bb))
    direct = xi < (aa + 1) / (aa + bb + 2)
    value = np.where(
        direct,
        front * _beta_fraction(aa, bb, xi) / aa,
        1 - front * _beta_fraction(bb, aa, 1 - xi) / bb,
    )
    value = np.where(xs <= 0, 0.0, np.where(xs >= 1, 1.0, value))
    out[ok] = value[ok]
    return out


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation of ``n`` pairs (t distribution, n - 2 degrees)."""
    rr, df = r.to_numpy(float), n.to_numpy(float) - 2
    rr = np.clip(rr, -1, 1)
    # t^2 / (t^2 + df) equals r^2, so the tail needs no division by 1 - r^2.
    p = incomplete_beta(np.where(df > 0, df / 2, np.nan), 0.5, 1 - rr * rr)
    return pd.Series(p).where(pd.notna(p), None)


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    ff, a, b = f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)
    return pd.Series(incomplete_beta(b / 2, a / 2, b / (b + a * ff)))


def student_t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection of the tail probability (driver-side constant)."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        upper = float(t_two_sided(mid, df)) / 2
        lo, hi = (mid, hi) if 1 - upper < p else (lo, mid)
    return (lo + hi) / 2


def kolmogorov_p_value(d, n1, n2) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov tail as a column expression."""
    d, n1, n2 = _col(d), _col(n1).cast("double"), _col(n2).cast("double")
    root = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (root + 0.12 + F.lit(0.11) / root) * d
    series = F.lit(0.0)
    for k in range(1, 101):
        series = series + F.exp(lam * lam * (-2.0 * k * k)) * (2.0 if k % 2 else -2.0)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
