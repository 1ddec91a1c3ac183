"""Sentiment, attention and event factors of each security's bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.frames import change, history, rolling_mean, rolling_std, rolling_std_pop
from alphaloom.functions.scalars import band, ratio
from alphaloom.operators.technical import drop_working, with_filled

YEAR = math.sqrt(252)

# Factors that use statistics of the whole series, later days included. They are kept for
# equal results and left out of training sets by default.
LOOKAHEAD = frozenset(
    {
        "attention_score",
        "attention_change_rate",
        "sentiment_strength",
        "sentiment_volatility",
        "sentiment_consistency",
        "sentiment_momentum",
    }
)


def whole_series():
    """All rows of one security, bounded by its trading days."""
    return W.partitionBy("ts_code")


def money_flow(df: DataFrame, n: int) -> DataFrame:
    w = history()
    df = df.withColumn("_mf", rolling_mean("amount", n, w))
    return df.withColumn(f"money_flow_{n}", band(change("_mf", n, w) * 100, -1000, 1000)).drop("_mf")


def net_inflow_rate(df: DataFrame) -> DataFrame:
    moved = ratio(F.col("close") - F.col("pre_close"), "pre_close")
    return df.withColumn("net_inflow_rate", band(ratio(moved * F.col("amount"), "amount") * 100, -100, 100))


def order_ratios(df: DataFrame) -> DataFrame:
    df = df.withColumn("_ap", ratio("amount", "vol"))
    big = (ratio("_ap", rolling_mean("_ap", 20, history())) - 1) * 100
    df = df.withColumn("big_order_ratio", band(big, -50, 50))
    size = F.abs("big_order_ratio")
    df = df.withColumn("medium_order_ratio", (F.lit(50.0) - size) / 2)
    return df.withColumn("small_order_ratio", F.lit(50.0) - size - F.col("medium_order_ratio")).drop("_ap")


def volume_price_agreement(df: DataFrame) -> DataFrame:
    w = history()
    df = df.withColumn("_agree", F.signum(change("close", 1, w)) * F.signum(change("vol", 1, w)))
    return df.withColumn("volume_price_trend", rolling_mean("_agree", 5, w) * 100).drop("_agree")


def attention(df: DataFrame) -> DataFrame:
    """Turnover, volume and price attention, their mix, and its five-day change."""
    w = history()
    proxy = ratio("vol", F.col("circ_mv") * 10000) * 100 if "circ_mv" in df.columns else F.lit(None).cast("double")
    turnover = F.col("turnover_rate") if "turnover_rate" in df.columns else proxy
    df = df.withColumns(
        {
            "turnover_attention": band(turnover, 0, 100, closed_lo=True),
            "volume_attention": band(ratio("vol", rolling_mean("vol", 20, w)), 0, 20),
            "price_attention": band(ratio(F.col("high") - F.col("low"), "close") * 100, 0, 50, closed_lo=True),
        }
    )
    parts = {"turnover_attention": 0.4, "volume_attention": 0.4, "price_attention": 0.2}
    edges = F.array(F.lit(0.05), F.lit(0.95))
    df = df.withColumns({f"_q_{c}": F.percentile(c, edges).over(whole_series()) for c in parts})
    mix = F.lit(0.0)
    for c, weight in parts.items():
        lo, hi = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        mix = mix + F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5) * weight
    df = df.withColumn("attention_score", mix * 100)
    return df.withColumn("attention_change_rate", band(change("attention_score", 5, w) * 100, -1000, 1000)).drop(
        *[f"_q_{c}" for c in parts]
    )


def strength(df: DataFrame) -> DataFrame:
    """Price momentum, volatility, their standardised mix and its ten-day spread."""
    w = history()
    df = df.withColumn("_chg", change("close", 1, w))
    df = df.withColumns(
        {
            "price_momentum_sentiment": band(change("close", 5, w) * 100, -100, 100),
            "volatility_sentiment": band(rolling_std("_chg", 20, w) * YEAR * 100, 0, 200, closed_lo=True),
        }
    )

    def z(c):
        return ratio(F.col(c) - F.avg(c).over(whole_series()), F.stddev_samp(c).over(whole_series()))

    df = df.withColumn(
        "sentiment_strength", (F.abs(z("price_momentum_sentiment")) * 0.6 + z("volatility_sentiment") * 0.4) * 50
    )
    return df.withColumn("sentiment_volatility", rolling_std("sentiment_strength", 10, w)).drop("_chg")


def bull_bear(df: DataFrame, n: int = 20) -> DataFrame:
    w = history()
    df = df.withColumn("_up", F.coalesce(change("close", 1, w) > 0, F.lit(False)).cast("double"))
    df = df.withColumn("bullish_ratio", rolling_mean("_up", n, w) * 100)
    return df.withColumn("bearish_ratio", F.lit(100.0) - F.col("bullish_ratio")).drop("_up")


def tone(df: DataFrame) -> DataFrame:
    """Intensity, consistency and momentum proxies from returns."""
    w, full = history(), whole_series()
    df = with_filled(df)
    df = df.withColumns(
        {
            "sentiment_intensity": F.lit(1.0) - F.exp(-F.abs(rolling_std("_ret", 5, w))),
            "_cs": rolling_std_pop("_ret", 10, w),
            "_mm": rolling_mean("_ret", 5, w) - rolling_mean("_ret", 20, w),
        }
    )
    df = df.withColumns({"_csx": F.max("_cs").over(full), "_lo": F.min("_mm").over(full), "_hi": F.max("_mm").over(full)})
    return df.withColumns(
        {
            "sentiment_consistency": F.when(F.col("_csx") > 0, F.lit(1.0) - F.col("_cs") / F.col("_csx")).otherwise(0.0),
            "sentiment_momentum": F.when(
                F.col("_hi") != F.col("_lo"), (F.col("_mm") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
            ).otherwise(0.5),
        }
    ).drop("_cs", "_mm", "_csx", "_lo", "_hi")


def news_score(df: DataFrame, feed: DataFrame) -> DataFrame:
    """Mean score over the news sources of the security and day; null without news."""
    daily = feed.groupBy("ts_code", F.col("news_date").alias("trade_date")).agg(
        F.avg("sentiment_score").alias("news_sentiment_score")
    )
    return df.join(daily, ["ts_code", "trade_date"], "left")


def abnormal(df: DataFrame, n: int = 20) -> DataFrame:
    w = history()
    df = df.withColumn("_chg", change("close", 1, w))

    def z(c):
        return band(ratio(F.col(c) - rolling_mean(c, n, w), rolling_std(c, n, w)), -10, 10)

    return df.withColumns({"abnormal_volume": z("vol"), "abnormal_return": z("_chg")}).drop("_chg")


def event_signals(df: DataFrame, spike: float = 2.0) -> DataFrame:
    """Limit, gap and volume-spike signals; an unknown rate gives 0."""
    moved = ratio(F.col("close") - F.col("pre_close"), "pre_close") * 100
    gap = ratio(F.col("open") - F.col("pre_close"), "pre_close") * 100
    burst = ratio("vol", rolling_mean("vol", 5, history()))
    return df.withColumns(
        {
            "price_limit_signal": F.when(moved >= 9.5, 1).when(moved <= -9.5, -1).otherwise(0),
            "gap_signal": F.when(gap >= 2, 1).when(gap <= -2, -1).otherwise(0),
            "volume_spike": F.when(burst >= spike, 1).otherwise(0),
        }
    )


def sentiment_factors(df: DataFrame, feed: DataFrame | None = None) -> DataFrame:
    """All sentiment factors; needs amount, vol, pre_close and turnover or market value."""
    for n in (5, 20):
        df = money_flow(df, n)
    df = volume_price_agreement(order_ratios(net_inflow_rate(df)))
    df = tone(bull_bear(strength(attention(df))))
    df = event_signals(abnormal(df))
    if feed is not None:
        df = news_score(df, feed)
    return drop_working(df)
