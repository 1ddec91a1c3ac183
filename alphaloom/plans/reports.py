"""Composed plans: preprocessing chain and the factor report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.operators import effectiveness as E
from alphaloom.operators import preprocess as P


def process_factors(
    df: DataFrame,
    factors: list[str],
    winsorize: str | None = "quantile",
    standardize: str | None = "zscore",
    neutralize: bool = True,
    cap: str = "market_cap",
    industry: str = "industry",
) -> DataFrame:
    """Winsorize, standardise and neutralise factors; null stages are left out.

    A stage groups the rows once for all factors, so the plan does not grow with their number.
    """
    if winsorize:
        df = P.winsorize(df, factors, winsorize)
    if standardize:
        df = P.standardize(df, factors, standardize)
    return P.neutralize(df, factors, cap, industry) if neutralize else df


def processed_long(df: DataFrame, factors: list[str]) -> DataFrame:
    """Processed factors as long rows named ``<factor>_processed``, nulls dropped."""
    named = df.select("ts_code", "trade_date", *[F.col(f).alias(f"{f}_processed") for f in factors])
    return E.to_long(named, [f"{f}_processed" for f in factors])


def factor_report(factors: DataFrame, returns: DataFrame | None, layers: int = 10, window: int = 20, max_periods: int = 20, wide=()) -> DataFrame:
    """Coefficients, ratio, layers, decay and rating of every factor in one table.

    Inputs are those of :func:`effectiveness.factor_decay`. Rows are exchanged once for all
    coefficients and once for the layers; what follows has at most a row per factor, period and day.
    """
    by_period = E.period_coefficients(factors, returns, range(max_periods + 1), wide=wide)
    ic = E.with_p_values(by_period.where("period = 0").drop("period"))
    ic_stats = E.ic_statistics(ic)
    ir_stats = E.ir_statistics(E.information_ratio(ic, window=window))
    layered = E.layered_by_days(factors, returns, layers, wide=wide)
    spread = E.long_short(E.layer_performance(layered))
    decay = E.decay_pattern(E.decay_profile(E.mean_by_period(by_period.where("period > 0"))))
    return E.rating(ic_stats, ir_stats, spread, decay)
