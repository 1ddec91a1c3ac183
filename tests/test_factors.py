"""Golden values and comparisons with pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import fundamental as Fu
from alphaloom.operators import sentiment as S
from alphaloom.operators import technical as T

# Price lists whose answers are known.
RSI_CLOSES = [10.00, 10.50, 10.20, 10.80, 10.60, 10.90, 11.00, 10.80, 11.20, 11.50, 11.30, 11.80, 11.60, 12.00]
SMA_CLOSES = [10.0, 10.5, 11.0, 10.8, 11.2, 11.5, 11.3, 12.0, 11.8, 12.2]


def series(spark, closes, code=1):
    day = dt.date(2024, 1, 1)
    rows = [(code, day + dt.timedelta(i), None if c is None else float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ts_code long, trade_date date, close double")


def values(df, col):
    return [r[col] for r in df.orderBy("ts_code", "trade_date").select(col).collect()]


def test_rsi_golden(spark):
    got = values(T.rsi(series(spark, RSI_CLOSES), 14), "rsi_14")
    assert got[:13] == [None] * 13
    assert got[13] == pytest.approx(73.8095, abs=1e-4)


def test_sma_golden(spark):
    got = values(T.sma(series(spark, SMA_CLOSES), 5), "sma_5")
    assert got[:4] == [None] * 4
    assert got[4:] == pytest.approx([10.7, 11.0, 11.16, 11.36, 11.56, 11.76])


def test_rsi_edges(spark):
    assert values(T.rsi(series(spark, [1, 2, 3, 4]), 3), "rsi_3")[3] == 100.0
    assert values(T.rsi(series(spark, [5, 5, 5, 5]), 3), "rsi_3")[3] is None


@pytest.mark.parametrize("span", [2, 9, 26])
def test_ema_matches_pandas_with_gaps_and_long_series(spark, span):
    rng = np.random.default_rng(42)
    x = 100 + rng.normal(size=1500).cumsum()
    x[[0, 7, 8, 300]] = np.nan
    want = pd.Series(x).ewm(span=span).mean()
    got = values(T.ema(series(spark, [None if np.isnan(v) else v for v in x]), span), f"ema_{span}")
    got = np.array([np.nan if v is None else v for v in got])
    assert np.allclose(got, want, rtol=1e-11, equal_nan=True)


def test_macd_matches_pandas(spark):
    x = pd.Series(50 + np.random.default_rng(1).normal(size=400).cumsum())
    line = x.ewm(span=12).mean() - x.ewm(span=26).mean()
    signal = line.ewm(span=9).mean()
    df = T.macd(series(spark, list(x)))
    assert np.allclose(values(df, "macd_histogram"), line - signal, atol=1e-9)


def test_volatility_forward_fills_prices(spark):
    x = pd.Series([10, 11, None, 12, 13, 12.5, 12.8])
    want = x.ffill().pct_change().rolling(3).std() * np.sqrt(252)
    got = values(T.volatility(series(spark, [None if pd.isna(v) else v for v in x]), 3), "volatility_3")
    assert [round(v, 9) if v is not None else None for v in got] == [round(v, 9) if pd.notna(v) else None for v in want]


def test_series_shorter_than_window_is_null(spark):
    assert values(T.sma(series(spark, [1, 2]), 5), "sma_5") == [None, None]


def test_constant_price_gives_null_position_and_no_error(spark):
    df = T.bollinger(series(spark, [5.0] * 25))
    assert values(df, "bb_position")[-1] is None


def test_event_signals_are_zero_without_a_previous_close(spark):
    df = series(spark, [10, 11]).withColumns({"open": F.col("close"), "vol": F.lit(1.0), "pre_close": F.lit(None).cast("double")})
    got = S.event_signals(df).orderBy("trade_date").collect()
    assert [(r.price_limit_signal, r.gap_signal, r.volume_spike) for r in got] == [(0, 0, 0), (0, 0, 0)]


def test_cagr_needs_a_positive_base(spark):
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(91 * i), float(v), 1.0) for i, v in enumerate([-5.0] + [8.0] * 11 + [27.0, 64.0])]
    df = spark.createDataFrame(rows, "ts_code long, end_date date, revenue double, net_profit double")
    got = [r.revenue_cagr_3y for r in Fu.growth(df).orderBy("end_date").collect()]
    assert got[12] is None
    assert got[13] == pytest.approx(100.0)


def test_empty_input(spark):
    empty = series(spark, []).withColumns({c: F.lit(1.0) for c in ("open", "high", "low", "vol", "amount", "pre_close")})
    assert T.technical_factors(empty).count() == 0
