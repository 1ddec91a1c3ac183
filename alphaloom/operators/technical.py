"""Technical factors: trailing-window indicators of each security's bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.frames import (
    change,
    forward_fill,
    history,
    rolling_max,
    rolling_mean,
    rolling_min,
    rolling_std,
    rolling_sum,
    upto_now,
)
from alphaloom.functions.scalars import ratio

YEAR = math.sqrt(252)


def with_filled(df: DataFrame, price: str = "close") -> DataFrame:
    """Add ``_fill``, the last known price, and ``_ret``, its one-day change."""
    if "_ret" in df.columns:
        return df
    w = history()
    return df.withColumn("_fill", forward_fill(price, w)).withColumn("_ret", change("_fill", 1, w))


def sma(df: DataFrame, n: int, price: str = "close", out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"sma_{n}", rolling_mean(price, n, history()))


def ema(df: DataFrame, span: int, price: str = "close", out: str | None = None) -> DataFrame:
    """Exponentially weighted mean with weights r^age normalised by their sum.

    Numerator and denominator are running sums of x * r^-j inside blocks of B rows, plus the
    block before. B is chosen so that anything older weighs less than a double can show, so the
    cost per row is constant and powers cannot overflow. Rows without a price carry no weight
    but still age the others.
    """
    r = 1 - 2 / (span + 1)
    size = max(2, math.ceil(math.log(1e-24) / math.log(r)))
    w = history()
    staged = df.withColumn("_i", F.row_number().over(w) - 1)
    staged = staged.select(
        "*",
        F.floor(F.col("_i") / size).cast("int").alias("_block"),
        (F.col("_i") % size).alias("_j"),
    )
    grow = F.pow(F.lit(1 / r), F.col("_j").cast("double"))
    x = F.col(price)
    staged = staged.select(
        "*",
        F.when(x.isNotNull(), x * grow).alias("_wx"),
        F.when(x.isNotNull(), grow).alias("_w1"),
    )
    inside = W.partitionBy("ts_code", "_block").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("ts_code").orderBy("_block").rangeBetween(-1, -1)
    shrink = r**size  # a value of the block before is one block older
    # The first frame's order by code, block and day also serves the second.
    staged = staged.withColumns({"_nx": F.sum("_wx").over(inside), "_n1": F.sum("_w1").over(inside)})

    def decayed(now, c):
        return F.coalesce(now, F.lit(0.0)) + F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) * shrink

    return staged.withColumn(out or f"ema_{span}", F.try_divide(decayed("_nx", "_wx"), decayed("_n1", "_w1"))).drop(
        "_i", "_block", "_j", "_wx", "_w1", "_nx", "_n1"
    )


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close") -> DataFrame:
    lines = ema(ema(df, fast, price, "_fast"), slow, price, "_slow").withColumn("macd", F.col("_fast") - F.col("_slow"))
    return (
        ema(lines, signal, "macd", "macd_signal")
        .withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
        .drop("_fast", "_slow")
    )


def rsi(df: DataFrame, n: int, price: str = "close", out: str | None = None) -> DataFrame:
    """Relative strength from plain rolling means; the first row counts as no change."""
    w = history()
    moved = df.withColumn("_d", F.coalesce(F.col(price) - F.lag(price).over(w), F.lit(0.0)))
    moved = moved.select("*", F.greatest("_d", F.lit(0.0)).alias("_up"), F.greatest(-F.col("_d"), F.lit(0.0)).alias("_dn"))
    up, dn = rolling_mean("_up", n, w), rolling_mean("_dn", n, w)
    moved = moved.withColumns({"_mu": up, "_md": dn})
    value = F.when(F.col("_md") == 0, F.when(F.col("_mu") > 0, 100.0)).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(F.col("_mu"), F.col("_md")))
    )
    return moved.withColumn(out or f"rsi_{n}", value).drop("_d", "_up", "_dn", "_mu", "_md")


def williams_r(df: DataFrame, n: int = 14) -> DataFrame:
    w = history()
    top, low = rolling_max("high", n, w), rolling_min("low", n, w)
    return df.withColumn(f"williams_r_{n}", ratio(top - F.col("close"), top - low) * -100)


def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    w = history()
    top, low = rolling_max("high", k, w), rolling_min("low", k, w)
    return df.withColumn("stoch_k", ratio(F.col("close") - low, top - low) * 100).withColumn(
        "stoch_d", rolling_mean("stoch_k", d, w)
    )


def momentum(df: DataFrame, n: int, price: str = "close") -> DataFrame:
    return df.withColumn(f"momentum_{n}", F.col(price) - F.lag(price, n).over(history()))


def roc(df: DataFrame, n: int) -> DataFrame:
    return with_filled(df).withColumn(f"roc_{n}", change("_fill", n, history()) * 100)


def price_to_sma(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn(f"price_to_sma{n}", ratio("close", rolling_mean("close", n, history())))


def volatility(df: DataFrame, n: int) -> DataFrame:
    return with_filled(df).withColumn(f"volatility_{n}", rolling_std("_ret", n, history()) * YEAR)


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Rolling mean of the true range; the first row's range is high minus low."""
    w = history()
    before = F.lag("close").over(w)
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return df.withColumn("_tr", span).withColumn(f"atr_{n}", rolling_mean("_tr", n, w)).drop("_tr")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, price: str = "close") -> DataFrame:
    w = history()
    df = df.withColumns({"bb_middle": rolling_mean(price, n, w), "_sd": rolling_std(price, n, w)})
    df = df.withColumns(
        {"bb_upper": F.col("bb_middle") + F.col("_sd") * k, "bb_lower": F.col("bb_middle") - F.col("_sd") * k}
    )
    width = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns(
        {"bb_width": ratio(width, "bb_middle"), "bb_position": ratio(F.col(price) - F.col("bb_lower"), width)}
    ).drop("_sd")


def volume_sma(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn(f"volume_sma_{n}", rolling_mean("vol", n, history()))


def volume_ratio(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn(f"volume_ratio_{n}", ratio("vol", rolling_mean("vol", n, history())))


def volume_price_trend(df: DataFrame) -> DataFrame:
    """Cumulative volume times price change; null where the change is null."""
    step = with_filled(df).withColumn("_vp", F.col("vol") * F.col("_ret"))
    total = F.sum("_vp").over(upto_now(history()))
    return step.withColumn("vpt", F.when(F.col("_vp").isNotNull(), total)).drop("_vp")


def mfi(df: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index; no falling money in the frame gives 100, none either way gives null."""
    w = history()
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumn("_prev", F.lag("_tp").over(w))
    flow = F.col("_tp") * F.col("vol")
    df = df.withColumns(
        {
            "_pos": F.when(F.col("_tp") > F.col("_prev"), flow).otherwise(0.0),
            "_neg": F.when(F.col("_tp") < F.col("_prev"), flow).otherwise(0.0),
        }
    )
    df = df.withColumns({"_sp": rolling_sum("_pos", n, w), "_sn": rolling_sum("_neg", n, w)})
    value = F.when(F.col("_sn") == 0, F.when(F.col("_sp") > 0, 100.0)).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(F.col("_sp"), F.col("_sn")))
    )
    return df.withColumn(f"mfi_{n}", value).drop("_tp", "_prev", "_pos", "_neg", "_sp", "_sn")


def with_min_history(df: DataFrame, n: int) -> DataFrame:
    """Keep securities with at least ``n`` rows."""
    return df.withColumn("_len", F.count("*").over(W.partitionBy("ts_code"))).where(F.col("_len") >= n).drop("_len")


def price_column(df: DataFrame) -> str:
    """The column the compatibility calls work on: ``close``, or the first numeric column."""
    if "close" in df.columns:
        return "close"
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "decimal")]
    return next(c for c in numeric if c != "ts_code")


def calculate_rsi(df: DataFrame, window: int = 14) -> DataFrame:
    return rsi(df, window, price_column(df), "rsi")


def calculate_macd(df: DataFrame, fast_period: int = 12, slow_period: int = 26, signal_period: int = 9) -> DataFrame:
    return macd(df, fast_period, slow_period, signal_period, price_column(df))


def calculate_bollinger_bands(df: DataFrame, window: int = 20, num_std: float = 2.0) -> DataFrame:
    return bollinger(df, window, num_std, price_column(df))


def calculate_sma(df: DataFrame, window: int = 20) -> DataFrame:
    return sma(df, window, price_column(df), "sma")


def calculate_ema(df: DataFrame, span: int = 20) -> DataFrame:
    return ema(df, span, price_column(df), "ema")


def drop_working(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def technical_factors(df: DataFrame) -> DataFrame:
    """All 35 technical factors; every window shares one ordering of the security's rows."""
    df = with_filled(df)
    for n in (5, 10, 20, 60):
        df = sma(df, n)
    df = price_to_sma(price_to_sma(df, 20), 60)
    for n in (6, 14):
        df = rsi(df, n)
    df = williams_r(df)
    for n in (5, 10, 20):
        df = roc(momentum(df, n), n)
    for n in (5, 20, 60):
        df = volatility(df, n)
    df = bollinger(atr(df))
    for n in (5, 20):
        df = volume_ratio(volume_sma(df, n), n)
    df = mfi(volume_price_trend(df))
    df = macd(ema(ema(df, 12), 26))
    return drop_working(df)


def outlier_counts(df: DataFrame, factors: list[str], sigmas: float = 3.0) -> DataFrame:
    """Values and three-sigma outliers per factor; the values themselves are kept."""
    long = df.unpivot([], factors, "factor_name", "x").where(F.col("x").isNotNull())
    from alphaloom.operators.crosssection import group_stats

    scored = group_stats(long, "factor_name", m=F.avg("x"), s=F.stddev_samp("x"))
    return scored.groupBy("factor_name").agg(
        F.count("*").alias("n_values"),
        F.count_if(F.abs(F.try_divide(F.col("x") - F.col("m"), F.col("s"))) > sigmas).alias("n_outliers"),
    )
