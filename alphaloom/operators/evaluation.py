"""Return and risk figures of strategies.

Input holds one row per (strategy_id, trade_date) with ``return``; windows are per strategy and
bounded by trading days, so many strategies evaluate in one job.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.frames import trailing, upto_now
from alphaloom.functions.stats import sample_kurtosis, sample_skew
from alphaloom.operators import crosssection as X
from alphaloom.session import cut

KEY, DATE, RET = "strategy_id", "trade_date", "return"


def _w():
    return W.partitionBy(KEY).orderBy(DATE)


def simple_returns(prices: DataFrame, price: str = "close") -> DataFrame:
    before = F.lag(price).over(_w())
    return prices.withColumn(RET, F.try_divide(F.col(price), before) - 1).where(F.col(RET).isNotNull())


def cumulative(df: DataFrame) -> DataFrame:
    """Compounded return up to each day."""
    return df.withColumn("cumulative_return", F.product(F.col(RET) + 1).over(upto_now(_w())) - 1)


def drawdowns(df: DataFrame) -> DataFrame:
    """Running peak and fall below it; the peak starts at the first return."""
    w = upto_now(_w())
    out = cumulative(df).withColumn("_i", F.row_number().over(_w()))
    out = out.withColumns(
        {"running_max": F.max("cumulative_return").over(w), "_peak": F.max_by("_i", F.struct("cumulative_return", -F.col("_i"))).over(w)}
    )
    fall = F.try_divide(F.col("cumulative_return") - F.col("running_max"), F.col("running_max") + 1)
    return out.withColumn("drawdown", fall)


def max_drawdown(df: DataFrame) -> DataFrame:
    """Deepest fall per strategy, its day, and the days from the peak to it, both counted."""
    return drawdowns(df).groupBy(KEY).agg(
        F.min("drawdown").alias("max_drawdown"),
        F.min_by(F.col("_i") - F.col("_peak") + 1, F.struct("drawdown", "_i")).cast("long").alias("max_drawdown_duration"),
        F.min_by(DATE, F.struct("drawdown", "_i")).alias("max_drawdown_end"),
    )


def performance(df: DataFrame, periods: int = 252, risk_free: float = 0.03) -> DataFrame:
    """Returns, risk, ratios, win figures and shape per strategy; one row each."""
    r = F.col(RET)
    base = df.where(r.isNotNull()).groupBy(KEY).agg(
        F.count("*").alias("n"),
        (F.product(r + 1) - 1).alias("total_return"),
        F.stddev_samp(r).alias("_sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        F.count_if(r < 0).alias("_losses"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(r > 0, r)).alias("_gain"),
        F.avg(F.when(r < 0, r)).alias("_loss"),
        sample_skew(r).alias("skewness"),
        sample_kurtosis(r).alias("kurtosis"),
        F.max(r).alias("best_day"),
        F.min(r).alias("worst_day"),
    )
    out = base.join(max_drawdown(df.where(r.isNotNull())), KEY)
    year = math.sqrt(periods)
    annual = F.pow(F.col("total_return") + 1, F.lit(float(periods)) / F.col("n")) - 1
    out = out.withColumns({"annualized_return": annual, "annualized_volatility": F.coalesce(F.col("_sd") * year, F.lit(0.0))})
    extra = F.col("annualized_return") - risk_free
    inf = F.lit(float("inf"))
    dd = F.abs("max_drawdown")
    return out.withColumns(
        {
            "sharpe_ratio": F.when(F.col("annualized_volatility") > 0, extra / F.col("annualized_volatility")).otherwise(0.0),
            "sortino_ratio": F.when(F.col("_losses") == 0, F.when(extra > 0, inf).otherwise(0.0))
            .when(F.col("_down") > 0, F.try_divide(extra, F.col("_down") * year))
            .otherwise(0.0),
            "calmar_ratio": F.when(dd > 0, F.try_divide("annualized_return", dd)).otherwise(F.when(F.col("annualized_return") > 0, inf).otherwise(0.0)),
            "profit_loss_ratio": F.coalesce(F.try_divide(F.col("_gain"), F.abs("_loss")), F.lit(0.0)),
        }
    ).drop("_sd", "_down", "_losses", "_gain", "_loss")


def tail_risk(df: DataFrame, level: float = 0.05) -> DataFrame:
    """Value at risk as the return quantile, and the mean of returns at or below it."""
    joined = X.with_quantiles(df.where(F.col(RET).isNotNull()), KEY, RET, {"_var": level})
    return joined.groupBy(KEY).agg(
        F.max("_var").alias("var"), F.avg(F.when(F.col(RET) <= F.col("_var"), F.col(RET))).alias("cvar")
    )


def against_benchmark(df: DataFrame, benchmark: DataFrame, periods: int = 252, risk_free: float = 0.03, annualize: bool = False) -> DataFrame:
    """Beta, alpha and information ratio against one benchmark return per day."""
    both = df.select(KEY, DATE, RET).join(benchmark.select(DATE, F.col(RET).alias("_b")), DATE).where(F.col(RET).isNotNull() & F.col("_b").isNotNull())
    r, b = F.col(RET), F.col("_b")
    agg = both.groupBy(KEY).agg(
        F.count("*").alias("_n"),
        F.covar_samp(r, b).alias("_cov"),
        F.var_samp(b).alias("_vb"),
        F.avg(r - b).alias("_m"),
        F.stddev_samp(r - b).alias("tracking_error"),
        F.product(r + 1).alias("_pr"),
        F.product(b + 1).alias("_pb"),
    )
    years = F.lit(float(periods)) / F.col("_n")
    beta = F.when(F.col("_vb") > 0, F.try_divide(F.col("_cov"), F.col("_vb"))).otherwise(1.0)
    scale = math.sqrt(periods) if annualize else 1.0
    out = agg.withColumn("beta", beta)
    gain_b = F.pow(F.col("_pb"), years) - 1 - risk_free
    return out.withColumns(
        {
            "alpha": F.pow(F.col("_pr"), years) - 1 - (F.col("beta") * gain_b + risk_free),
            "information_ratio": F.when(F.col("tracking_error") > 0, F.try_divide(F.col("_m"), F.col("tracking_error")) * scale).otherwise(0.0),
        }
    ).drop("_n", "_cov", "_vb", "_m", "_pr", "_pb")


def evaluate(df: DataFrame, benchmark: DataFrame | None = None, periods: int = 252) -> DataFrame:
    """The full evaluation row of every strategy.

    The returns, one row per strategy and day, are cut from their lineage first, as each part of
    the row reads them again.
    """
    df = cut(df)
    out = performance(df, periods).join(tail_risk(df), KEY)
    return out.join(against_benchmark(df, benchmark, periods), KEY, "left") if benchmark is not None else out


def rolling_sharpe(df: DataFrame, window: int = 60, periods: int = 252, risk_free: float = 0.03) -> DataFrame:
    """Sharpe ratio of the last k returns, k the smaller of ``window`` and a quarter of the rows.

    As k differs between strategies, the frame holds ``window`` values and its tail is used.
    """
    w = _w()
    out = df.withColumns(
        {
            "_k": F.least(F.lit(window), F.floor(F.count("*").over(W.partitionBy(KEY)) / 4)).cast("int"),
            "_last": F.collect_list(RET).over(trailing(w, window)),
        }
    )
    k = F.col("_k")
    out = out.withColumn("_last", F.when((k > 1) & (F.size("_last") >= k), F.slice("_last", F.size("_last") - k + 1, k)))
    n = k.cast("double")
    out = out.withColumns(
        {
            "_prod": F.aggregate("_last", F.lit(1.0), lambda acc, x: acc * (x + 1)),
            "_mean": F.aggregate("_last", F.lit(0.0), lambda acc, x: acc + x) / n,
        }
    )
    out = out.withColumn("_ss", F.aggregate("_last", F.lit(0.0), lambda acc, x: acc + (x - F.col("_mean")) * (x - F.col("_mean"))))
    risk = F.sqrt(F.col("_ss") / (n - 1)) * math.sqrt(periods)
    annual = F.pow(F.col("_prod"), F.lit(float(periods)) / n) - 1
    value = F.when(F.col("_last").isNotNull(), F.when(risk > 0, (annual - risk_free) / risk).otherwise(0.0))
    return out.withColumn("rolling_sharpe", value).drop("_k", "_last", "_prod", "_mean", "_ss")


def monthly_returns(df: DataFrame) -> DataFrame:
    """Compounded return per calendar month."""
    return df.groupBy(KEY, F.year(DATE).alias("year"), F.month(DATE).alias("month")).agg((F.product(F.col(RET) + 1) - 1).alias("monthly_return"))


def monthly_table(df: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Months by years of compounded returns; all years of the data unless some are named."""
    return monthly_returns(df).groupBy(KEY, "month").pivot("year", years).agg(F.first("monthly_return"))


def trade_statistics(trades: DataFrame, average_value: float, days: int) -> DataFrame:
    """Counts, win rate, mean holding days and yearly turnover of a trade log.

    Each sell is set against the first buy of its security before it; sells without one count in
    the divisors only.
    """
    buys = trades.where(F.col("action") == "buy")
    first = buys.groupBy("strategy_id", "ts_code").agg(
        F.min(DATE).alias("_bd"), F.min_by("amount", DATE).alias("_ba"), F.min_by("commission", DATE).alias("_bc")
    )
    joined = trades.join(first, ["strategy_id", "ts_code"], "left")
    sell = F.col("action") == "sell"
    paired = sell & (F.col("_bd") < F.col(DATE))
    pnl = F.col("amount") - F.col("_ba") - F.col("commission") - F.col("_bc")
    out = joined.groupBy("strategy_id").agg(
        F.count("*").alias("total_trades"),
        F.count_if(sell).alias("sells"),
        F.count_if(paired & (pnl > 0)).alias("wins"),
        F.sum(F.when(paired, F.datediff(DATE, "_bd"))).alias("_held"),
        F.sum(F.when(F.col("action") == "buy", F.col("amount"))).alias("_bought"),
    )
    return out.select(
        "strategy_id",
        "total_trades",
        F.coalesce(F.try_divide(F.col("wins"), F.col("sells")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.try_divide(F.col("_held"), F.col("sells")), F.lit(0.0)).alias("avg_holding_days"),
        (F.coalesce("_bought", F.lit(0.0)) / average_value / (days / 252)).alias("turnover_rate"),
    )


def compare(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Long comparison of strategies with the place of each by metric, best first."""
    long = results.select(KEY, *metrics).unpivot([KEY], metrics, "metric", "value")
    return long.withColumn("place", F.row_number().over(W.partitionBy("metric").orderBy(F.desc_nulls_last("value"), KEY)))


def result_list(results: DataFrame, strategies: list[str] | None = None, limit: int = 50) -> DataFrame:
    if strategies:
        results = results.where(F.col(KEY).isin(strategies))
    return results.orderBy(F.desc("total_return"), KEY).limit(limit)


def point_to_point(bars: DataFrame, start, end) -> DataFrame:
    """Return between two given days per security; null unless both closes exist and start > 0.

    Both days are read in one filtered scan and placed side by side by an aggregate.
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    picked = bars.where(F.col(DATE).isin(a, b)).groupBy("ts_code").agg(
        F.max(F.when(F.col(DATE) == a, F.col("close"))).alias("start_price"), F.max(F.when(F.col(DATE) == b, F.col("close"))).alias("end_price")
    )
    gain = F.when(F.col("start_price") > 0, (F.col("end_price") - F.col("start_price")) / F.col("start_price"))
    return picked.withColumns({"period_return": gain, "period_return_pct": gain * 100})
