"""Trailing-frame expressions over one security's history.

A rolling figure is null until its frame holds ``n`` non-null values. Rows per security are
bounded by the number of trading days, because the panel holds one row per (code, day).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def history(key: str | list[str] = "ts_code", order: str = "trade_date") -> WindowSpec:
    keys = [key] if isinstance(key, str) else key
    return W.partitionBy(*keys).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def upto_now(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(W.unboundedPreceding, 0)


def full_frame(agg, x, n: int, w: WindowSpec) -> Column:
    """``agg`` over the last ``n`` rows once all of them hold a value."""
    x, f = _col(x), trailing(w, n)
    return F.when(F.count(x).over(f) == n, agg(x).over(f))


def rolling_mean(x, n, w) -> Column:
    return full_frame(F.avg, x, n, w)


def rolling_sum(x, n, w) -> Column:
    return full_frame(F.sum, x, n, w)


def rolling_std(x, n, w) -> Column:
    return full_frame(F.stddev_samp, x, n, w)


def rolling_std_pop(x, n, w) -> Column:
    return full_frame(F.stddev_pop, x, n, w)


def rolling_max(x, n, w) -> Column:
    return full_frame(F.max, x, n, w)


def rolling_min(x, n, w) -> Column:
    return full_frame(F.min, x, n, w)


def forward_fill(x, w) -> Column:
    return F.last(_col(x), ignorenulls=True).over(upto_now(w))


def backward_fill(x, w) -> Column:
    return F.first(_col(x), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))


def change(x, n: int, w) -> Column:
    """Relative change against the value ``n`` rows earlier."""
    x = _col(x)
    return F.try_divide(x, F.lag(x, n).over(w)) - 1
