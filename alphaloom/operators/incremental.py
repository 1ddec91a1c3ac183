"""Incremental factor computation: last dates, missing days, look-back scans and logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE, DATE, FACTOR = "ts_code", "trade_date", "factor_name"


def last_dates(values: DataFrame) -> DataFrame:
    return values.groupBy(CODE, FACTOR).agg(F.max(DATE).alias("last_date"))


def start_days(codes: DataFrame, factors: list[str], values: DataFrame, as_of, default_days: int = 365) -> DataFrame:
    """First day to compute per security and factor: after the last value, else the listing day,
    else a year before ``as_of``."""
    wanted = codes.select(CODE, "list_date").withColumn(FACTOR, F.explode(F.array(*[F.lit(f) for f in factors])))
    fallback = F.coalesce("list_date", F.date_sub(F.lit(as_of).cast("date"), default_days))
    return wanted.join(last_dates(values), [CODE, FACTOR], "left").select(
        CODE, FACTOR, F.coalesce(F.date_add("last_date", 1), fallback).alias("start_date")
    )


def missing_days(codes: DataFrame, factors: list[str], values: DataFrame, calendar: DataFrame, as_of) -> DataFrame:
    """Open days without a value per security and factor.

    The span from the start day to ``as_of`` is a per-row array of days, so days come from an
    explode and one join with the calendar rather than from pairing all days with all keys.
    """
    starts = start_days(codes, factors, values, as_of)
    until = F.lit(as_of).cast("date")
    spans = starts.where(F.col("start_date") <= until).withColumn(DATE, F.explode(F.sequence("start_date", until)))
    days = calendar.where(F.col("is_open") == 1).select(F.col("cal_date").alias(DATE))
    open_spans = spans.drop("start_date").join(days, DATE, "left_semi")
    return open_spans.join(values.select(CODE, FACTOR, DATE), [CODE, FACTOR, DATE], "left_anti")


def needed_months(bars: DataFrame, missing: DataFrame, lookback: int, margin: int = 10) -> DataFrame:
    """Months from the first missing day less the look-back and a margin to the last month of the bars.

    One row a month of the span, so it is as small as a calendar. The bars' last month comes from
    the names of their folders.
    """
    last = bars.agg(F.to_date(F.concat(F.max("month"), F.lit("-01"))).alias("b"))
    span = missing.agg(F.min(DATE).alias("a")).where(F.col("a").isNotNull()).crossJoin(F.broadcast(last))  # single rows
    begin = F.trunc(F.date_sub("a", lookback + margin), "month")
    months = F.sequence(begin, F.greatest(begin, "b"), F.expr("INTERVAL 1 MONTH"))
    return span.select(F.explode(months).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


def lookback_scan(bars: DataFrame, missing: DataFrame, lookback: int, margin: int = 10) -> DataFrame:
    """Bars needed for the missing days: each security from its first missing day less the
    look-back and a margin on.

    Bars with a ``month`` column that is a folder of their files are read from the needed months
    only: the join with these is broadcast, and the scan waits for it to know its folders.
    """
    if "month" in bars.columns:
        bars = bars.join(F.broadcast(needed_months(bars, missing, lookback, margin)), "month", "left_semi").drop("month")
    span = missing.groupBy(CODE).agg(F.min(DATE).alias("_first"))
    return bars.join(span, CODE).where(F.col(DATE) >= F.date_sub("_first", lookback + margin)).drop("_first")


def compute_missing(bars: DataFrame, missing: DataFrame, factors: dict[str, tuple[Callable[[DataFrame], DataFrame], int]]) -> DataFrame:
    """Compute factors over the look-back rows and keep the missing days, long.

    ``factors`` maps a name to its function and its look-back in calendar days.
    """
    need = max(days for _, days in factors.values())
    frame = lookback_scan(bars, missing, need)
    for fn, _ in factors.values():
        frame = fn(frame)
    names = list(factors)
    long = frame.select(CODE, DATE, *names).unpivot([CODE, DATE], names, FACTOR, "factor_value")
    return long.join(missing.select(CODE, FACTOR, DATE), [CODE, FACTOR, DATE], "left_semi").where(F.col("factor_value").isNotNull())


def run_log(results: DataFrame, status: str = "success") -> DataFrame:
    """One log row per security and factor of a run."""
    return results.groupBy(CODE, FACTOR).agg(F.count("*").alias("records"), F.max(DATE).alias("calculation_date")).withColumn("status", F.lit(status))


def calculation_history(log: DataFrame, limit: int = 50) -> DataFrame:
    return log.orderBy(F.desc("calculation_date"), CODE, FACTOR).limit(limit)
