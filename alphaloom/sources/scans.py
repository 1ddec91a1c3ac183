"""Filtered scans. Every predicate stays a plain column comparison, so it reaches the file scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE, DATE = "ts_code", "trade_date"


def where_given(df: DataFrame, equals: dict | None = None, in_list: dict | None = None, since: dict | None = None, until: dict | None = None) -> DataFrame:
    """Apply only the predicates that have a value."""
    for c, v in (equals or {}).items():
        if v is not None:
            df = df.where(F.col(c) == v)
    for c, v in (in_list or {}).items():
        if v:
            df = df.where(F.col(c).isin(list(v)))
    for c, v in (since or {}).items():
        if v is not None:
            df = df.where(F.col(c) >= F.lit(v).cast("date"))
    for c, v in (until or {}).items():
        if v is not None:
            df = df.where(F.col(c) <= F.lit(v).cast("date"))
    return df


def stock_data(bars: DataFrame, code=None, start=None, end=None, limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Bars by code and dates, in date order, optionally some columns and the first rows."""
    out = where_given(bars, {CODE: code}, None, {DATE: start}, {DATE: end})
    if columns:
        out = out.select(*dict.fromkeys([CODE, DATE, *columns]))
    if limit:
        return out.orderBy(DATE, CODE).limit(limit)
    return out.orderBy(DATE, CODE)


def stock_list(stocks: DataFrame, list_status: str = "L") -> DataFrame:
    return stocks.where(F.col("list_status") == list_status).select(CODE).distinct().orderBy(CODE)


def open_days(calendar: DataFrame, start=None, end=None) -> DataFrame:
    return where_given(calendar.where(F.col("is_open") == 1), None, None, {"cal_date": start}, {"cal_date": end}).select("cal_date").orderBy("cal_date")


def factor_data(long: DataFrame, names: list[str], start=None, end=None, codes: list | None = None) -> DataFrame:
    """Long factor rows by names, dates and codes, pivoted to one column per name."""
    rows = where_given(long, None, {"factor_name": names, CODE: codes}, {DATE: start}, {DATE: end})
    return rows.groupBy(CODE, DATE).pivot("factor_name", names).agg(F.first("factor_value", ignorenulls=True))


def market_caps(daily: DataFrame, start=None, end=None) -> DataFrame:
    return where_given(daily, None, None, {DATE: start}, {DATE: end}).where(F.col("total_mv").isNotNull()).select(CODE, DATE, F.col("total_mv").alias("market_cap"))


def search_factors(catalogue: DataFrame, query: str | None = None, factor_type: str | None = None, category: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Case-blind text search over name and description with type, category and tag overlap."""
    out = where_given(catalogue, {"factor_type": factor_type, "category": category})
    if query:
        like = f"%{query}%"
        out = out.where(F.col("factor_name").ilike(like) | F.col("description").ilike(like))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return out


def latest_rows(df: DataFrame, n: int, time: str = DATE, tie: str = CODE) -> DataFrame:
    return df.orderBy(F.desc(time), tie).limit(n)


def top_by_metric(df: DataFrame, metric: str, n: int, allowed: tuple[str, ...], tie: str) -> DataFrame:
    if metric not in allowed:
        raise ValueError(f"cannot sort by {metric}")
    return df.orderBy(F.desc(metric), tie).limit(n)


def missing_columns(df: DataFrame, wanted: list[str], fill: float = 0.0) -> DataFrame:
    """Add wanted columns that are absent, make non-finite numbers null and nulls zero."""
    for c in wanted:
        df = df.withColumn(c, F.lit(fill)) if c not in df.columns else df
    clean = {c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), fill).otherwise(F.col(c)) for c in wanted}
    return df.withColumns(clean)


def config_violations(params: DataFrame, constraints: DataFrame) -> DataFrame:
    """Parameters outside their bounds or allowed values; one row per parameter and reason."""
    v = F.col("value")
    joined = params.join(constraints, "parameter")
    reason = (
        F.when(v < F.col("min_value"), "below_minimum")
        .when(v > F.col("max_value"), "above_maximum")
        .when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", v), "not_allowed")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull())
