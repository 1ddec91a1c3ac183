"""Column functions for projections and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den) -> Column:
    """Division that yields null for a zero or null denominator."""
    return F.try_divide(_col(num), _col(den))


def band(x, lo: float | None = None, hi: float | None = None, closed_lo: bool = False) -> Column:
    """Keep a value inside an interval, else null. Open unless ``closed_lo``."""
    x = _col(x)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((x >= lo) if closed_lo else (x > lo))
    if hi is not None:
        cond = cond & (x < hi)
    return F.when(cond, x)


def clip(x, lo, hi) -> Column:
    """Limit to [lo, hi]; null stays null and a null bound is ignored."""
    x = _col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi if isinstance(hi, Column) else F.lit(hi)), lo if isinstance(lo, Column) else F.lit(lo)))


def finite(x) -> Column:
    """NaN and infinities become null."""
    x = _col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def compare(value, threshold, op) -> Column:
    """Apply the comparison named by the data; unknown names are false."""
    v, t, name = _col(value), _col(threshold), _col(op)
    return F.coalesce(
        F.when(name == ">", v > t)
        .when(name == "<", v < t)
        .when(name == ">=", v >= t)
        .when(name == "<=", v <= t)
        .when(name == "==", v == t)
        .when(name == "!=", v != t),
        F.lit(False),
    )


def grade_by_percentile(p) -> Column:
    """Letter grade by percentile rank, 0 the best: A to 0.2, then steps of 0.2."""
    p = _col(p)
    return F.when(p <= 0.2, "A").when(p <= 0.4, "B").when(p <= 0.6, "C").when(p <= 0.8, "D").otherwise("E")


def grade_by_score(score) -> Column:
    score = _col(score)
    return F.when(score >= 80, "A").when(score >= 70, "B").when(score >= 60, "C").when(score >= 50, "D").otherwise("F")


def quality_status(score) -> Column:
    score = _col(score)
    return F.when(score >= 95, "PASS").when(score >= 80, "WARN").otherwise("FAIL")


def is_security_code(x) -> Column:
    """Six digits and an exchange suffix."""
    return _col(x).rlike(r"^[0-9]{6}\.(SZ|SH)$")


def row_mean(cols: list) -> Column:
    """Mean over the columns of a row, ignoring nulls."""
    total = reduce(lambda a, b: a + b, [F.coalesce(_col(c), F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [_col(c).isNotNull().cast("int") for c in cols])
    return F.try_divide(total, n)


def sigmoid_score(x) -> Column:
    """Logistic map onto 0..100."""
    return F.lit(100.0) / (F.lit(1.0) + F.exp(-_col(x)))


def calculate_return(start, end) -> Column:
    """Percentage return between two prices, null when the start is not positive."""
    s, e = _col(start), _col(end)
    return F.when(s > 0, (e - s) / s)


def inverse_normal(p) -> Column:
    """Standard normal quantile for 0 < p < 1.

    Rational approximation of P. J. Acklam, relative error about 1e-9, as JVM expressions.
    """
    p = _col(p)
    # Published coefficients of the approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(coefs, x):
        return reduce(lambda acc, k: acc * x + k, coefs[1:], F.lit(coefs[0]))

    low = F.sqrt(F.log(p) * -2)
    high = F.sqrt(F.log(F.lit(1.0) - p) * -2)
    q = p - 0.5
    r = q * q
    tail_low = poly(c, low) / (poly(d, low) * low + 1)
    tail_high = -poly(c, high) / (poly(d, high) * high + 1)
    middle = poly(a, r) * q / (poly(b, r) * r + 1)
    return F.when(p < 0.02425, tail_low).when(p > 1 - 0.02425, tail_high).otherwise(middle)
