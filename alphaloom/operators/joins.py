"""Joins of panels, statements, memberships and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.frames import history, upto_now


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, key: str = "ts_code") -> DataFrame:
    """Add to each left row the latest right row of its key dated at or before it.

    Both sides are stacked and the last right row is carried forward, so the cost is one exchange
    and one sort however many rows match. Equal times take the right row as known. One task holds
    one security's days and statements, both bounded by the calendar.
    """
    payload = [c for c in right.columns if c != key]
    stacked = left.select(
        "*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("_r")
    ).unionByName(
        right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*payload).alias("_r")),
        allowMissingColumns=True,
    )
    w = upto_now(W.partitionBy(key).orderBy("_t", "_side"))
    carried = stacked.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    taken = set(left.columns)
    return carried.select(*left.columns, *[F.col("_r")[c].alias(c) for c in payload if c not in taken])


def every_report(market: DataFrame, statements: DataFrame) -> DataFrame:
    """Pair every market row with every report of its security (the fan-out form)."""
    return market.join(statements, "ts_code", "left")


def membership_on(df: DataFrame, members: DataFrame, day: str = "trade_date") -> DataFrame:
    """Membership valid on the row's day: in_date <= day < out_date, open-ended when null.

    Equality on the security drives the join; the dates are a residual condition.
    """
    m = members.withColumnRenamed("ts_code", "_member")
    valid = (F.col("in_date") <= F.col(day)) & (F.col("out_date").isNull() | (F.col(day) < F.col("out_date")))
    return df.join(m, (F.col("ts_code") == F.col("_member")) & valid, "left").drop("_member")


def compare_full(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison of one value, with difference and relative change."""
    o = old.select(*keys, F.col(value).alias("old_value"))
    n = new.select(*keys, F.col(value).alias("new_value"))
    diff = F.col("new_value") - F.col("old_value")
    return o.join(n, keys, "full_outer").select(
        *keys,
        "old_value",
        "new_value",
        diff.alias("difference"),
        F.try_divide(diff, F.abs("old_value")).alias("pct_change"),
        F.col("old_value").eqNullSafe(F.col("new_value")).alias("same"),
    )


def latest_row(df: DataFrame, by: str | list[str], time: str) -> DataFrame:
    """The newest row of each group, by an aggregate that combines on the map side."""
    keys = [by] if isinstance(by, str) else list(by)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(time)).alias("_r"))
    return picked.select(*keys, "_r.*")


def latest_day_rows(df: DataFrame, by: str | list[str], time: str) -> DataFrame:
    """All rows of each group's newest day."""
    keys = [by] if isinstance(by, str) else list(by)
    newest = df.groupBy(*keys).agg(F.max(time).alias(time))
    return df.join(newest, [*keys, time], "left_semi")


def global_latest_rows(df: DataFrame, time: str) -> DataFrame:
    """Rows of the newest day of the whole table."""
    newest = df.agg(F.max(time).alias(time))
    return df.join(newest, time, "left_semi")


def first_earlier_buy(trades: DataFrame, by: tuple[str, ...] = ("strategy_id", "ts_code")) -> DataFrame:
    """Pair each sell with the first buy of the same strategy and security before it.

    Their first buy is one number, so pairing needs no comparison of all pairs.
    """
    buys = trades.where(F.col("action") == "buy")
    opening = buys.groupBy(*by).agg(F.min("trade_date").alias("buy_date"), F.min_by("price", "trade_date").alias("buy_price"))
    sells = trades.where(F.col("action") == "sell").select(*by, F.col("trade_date").alias("sell_date"), F.col("price").alias("sell_price"))
    return sells.join(opening, list(by)).where(F.col("buy_date") < F.col("sell_date"))


def not_held(candidates: DataFrame, holdings: DataFrame) -> DataFrame:
    return candidates.join(holdings.select("ts_code"), "ts_code", "left_anti")


def only_held(df: DataFrame, holdings: DataFrame) -> DataFrame:
    return df.join(holdings.select("ts_code"), "ts_code", "left_semi")


def set_overlap(left: DataFrame, right: DataFrame, key: str = "ts_code") -> DataFrame:
    """Shared and total keys of two tables and whether the overlap is under 80 %."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    seen = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    out = seen.agg(
        F.sum(F.col("l") * F.col("r")).alias("common"),
        F.count("*").alias("total"),
    )
    share = F.try_divide(F.col("common"), F.col("total"))
    return out.select("common", "total", share.alias("overlap"), (share < 0.8).alias("low_overlap"))


def wide_security_view(stock: DataFrame, market: DataFrame, *factor_frames: DataFrame) -> DataFrame:
    """Security, bar and factor tables joined left on (code, day)."""
    out = market.join(stock, "ts_code", "left")
    for frame in factor_frames:
        out = out.join(frame, ["ts_code", "trade_date"], "left")
    return out


def carried(df: DataFrame, value: str, w=None) -> Column:
    return F.last(value, ignorenulls=True).over(upto_now(w or history()))
