"""Fundamental factors of quarterly statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.functions.frames import change, history, rolling_sum
from alphaloom.functions.scalars import band, clip, ratio

EQUITY = "total_hldr_eqy_exc_min_int"


def quarters():
    return history("ts_code", "end_date")


def with_ttm(df: DataFrame, cols=("net_profit", "revenue", "operating_cash_flow", "ebitda")) -> DataFrame:
    """Trailing four-quarter sums, null until four quarters are known."""
    return df.withColumns({f"{c}_ttm": rolling_sum(c, 4, quarters()) for c in cols})


def valuation(df: DataFrame) -> DataFrame:
    """Price multiples; needs ``total_mv`` and the trailing sums."""
    df = df.withColumns(
        {
            "pe_ttm": band(ratio("total_mv", "net_profit_ttm"), 0, 1000),
            "pb": band(ratio("total_mv", EQUITY), 0, 100),
            "ps_ttm": band(ratio("total_mv", "revenue_ttm"), 0, 100),
            "pcf_ttm": band(ratio("total_mv", "operating_cash_flow_ttm"), 0, 1000),
            "ev_ebitda": band(ratio("total_mv", "ebitda_ttm"), 0, 1000),
        }
    )
    if "net_profit_yoy" in df.columns:
        df = df.withColumn("peg", band(ratio("pe_ttm", F.col("net_profit_yoy") * 100), 0, 10))
    return df


def profitability(df: DataFrame) -> DataFrame:
    capital = F.col("total_assets") - F.col("total_cur_liab") * 0.5
    sales = F.col("revenue")
    return df.withColumns(
        {
            "roe": clip(ratio("net_profit", EQUITY) * 100, -100.0, 100.0),
            "roa": clip(ratio("net_profit", "total_assets") * 100, -100.0, 100.0),
            "roic": band(ratio("operate_profit", capital) * 100, -50, 50),
            "gross_margin": band(ratio(sales - F.col("oper_cost"), sales) * 100, -100, 100),
            "net_margin": band(ratio("net_profit", sales) * 100, -100, 100),
            "operating_margin": band(ratio("operate_profit", sales) * 100, -100, 100),
        }
    )


def _cagr(c: str, periods: int = 12) -> Column:
    base = F.lag(c, periods).over(quarters())
    growth = ratio(c, base)
    return F.when((base > 0) & (growth >= 0), (F.pow(growth, F.lit(4.0 / periods)) - 1) * 100)


def growth(df: DataFrame) -> DataFrame:
    w = quarters()
    return df.withColumns(
        {
            "revenue_yoy": band(change("revenue", 4, w) * 100, -100, 1000),
            "revenue_qoq": band(change("revenue", 1, w) * 100, -100, 1000),
            "net_profit_yoy": band(change("net_profit", 4, w) * 100, -1000, 1000),
            "net_profit_qoq": band(change("net_profit", 1, w) * 100, -1000, 1000),
            "revenue_cagr_3y": _cagr("revenue"),
            "net_profit_cagr_3y": _cagr("net_profit"),
        }
    )


def soundness(df: DataFrame) -> DataFrame:
    """Leverage, liquidity and efficiency ratios."""
    liquid = F.col("total_cur_assets") - F.coalesce(F.col("inventories"), F.lit(0.0))
    return df.withColumns(
        {
            "debt_to_equity": band(ratio("total_liab", EQUITY), 0, 10, closed_lo=True),
            "current_ratio": band(ratio("total_cur_assets", "total_cur_liab"), 0, 20, closed_lo=True),
            "quick_ratio": band(ratio(liquid, "total_cur_liab"), 0, 20, closed_lo=True),
            "cash_ratio": band(ratio("money_cap", "total_cur_liab"), 0, 10, closed_lo=True),
            "asset_turnover": band(ratio("revenue", "total_assets"), 0, 10, closed_lo=True),
            "interest_coverage": band(ratio("operate_profit", F.abs("fin_exp")), 0, 1000),
        }
    )


def percent_ratios(df: DataFrame) -> DataFrame:
    """The older percent-scaled ratios without range limits."""
    return df.withColumns(
        {
            "gross_margin_pct": ratio(F.col("revenue") - F.col("oper_cost"), "revenue") * 100,
            "net_margin_pct": ratio("net_profit", "revenue") * 100,
            "debt_to_equity_pct": ratio("total_liab", EQUITY) * 100,
            "current_ratio_raw": ratio("total_cur_assets", "total_cur_liab"),
            "quick_ratio_raw": ratio(F.col("total_cur_assets") - F.coalesce("inventories", F.lit(0.0)), "total_cur_liab"),
        }
    )
