"""Registry of factors: built-in ones and those a user adds.

A factor is a function that adds its columns to a bar table, with the columns it needs, its
shortest usable history and whether it looks ahead. Registered factors compute together in one
plan; what depends on what is settled by the columns of that plan.
"""

from __future__ import annotations

import dataclasses
import functools
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from alphaloom.operators import fundamental as Fu
from alphaloom.operators import sentiment as S
from alphaloom.operators import technical as T


@dataclass(frozen=True)
class Factor:
    name: str
    fn: Callable[[DataFrame], DataFrame]
    requires: tuple[str, ...] = ("close",)
    min_periods: int = 1
    kind: str = "technical"
    category: str = "custom"
    lookahead: bool = False
    outputs: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return self.outputs or (self.name,)


@dataclass(frozen=True)
class FactorSettings:
    """Windows of the built-in factors; a mapping overrides single values."""

    sma: tuple[int, ...] = (5, 10, 20, 60)
    ema: tuple[int, ...] = (12, 26)
    rsi: tuple[int, ...] = (6, 14)
    momentum: tuple[int, ...] = (5, 10, 20)
    volatility: tuple[int, ...] = (5, 20, 60)
    volume: tuple[int, ...] = (5, 20)
    atr: int = 14
    williams: int = 14
    mfi: int = 14
    bollinger: int = 20
    bollinger_sds: float = 2.0
    money_flow: tuple[int, ...] = (5, 20)
    disabled: tuple[str, ...] = ()

    @classmethod
    def of(cls, values: dict | str | None) -> FactorSettings:
        """Settings from a mapping or a JSON text; unknown names are an error."""
        values = json.loads(values) if isinstance(values, str) else dict(values or {})
        known = {f.name for f in dataclasses.fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


@dataclass
class Registry:
    factors: dict[str, Factor] = field(default_factory=dict)

    def add(self, factor: Factor) -> None:
        if factor.name in self.factors:
            raise ValueError(f"factor {factor.name} exists")
        self.factors[factor.name] = factor

    def factor(self, name: str, **meta):
        """Decorator that registers a user's factor."""

        def wrap(fn):
            self.add(Factor(name, fn, **meta))
            return fn

        return wrap

    def names(self, kind: str | None = None, category: str | None = None, lookahead: bool | None = None) -> list[str]:
        return [
            f.name
            for f in self.factors.values()
            if kind in (None, f.kind) and category in (None, f.category) and lookahead in (None, f.lookahead)
        ]

    def metadata(self, spark: SparkSession) -> DataFrame:
        rows = [(f.name, f.kind, f.category, list(f.requires), f.min_periods, f.lookahead, list(f.columns)) for f in self.factors.values()]
        return spark.createDataFrame(
            rows, "factor_name string, factor_type string, category string, requires array<string>, min_periods int, lookahead boolean, outputs array<string>"
        )

    def compute(self, bars: DataFrame, names: list[str], keep_short: bool = True) -> DataFrame:
        """Add the named factors; securities shorter than a factor's history can be left out."""
        chosen = [self.factors[n] for n in names]
        missing = sorted({c for f in chosen for c in f.requires} - set(bars.columns))
        if missing:
            raise ValueError(f"missing columns {missing}")
        out = bars if keep_short else T.with_min_history(bars, max(f.min_periods for f in chosen))
        for f in chosen:
            out = f.fn(out)
        return T.drop_working(out).select(*bars.columns, *dict.fromkeys(c for f in chosen for c in f.columns))


def default_registry(settings: FactorSettings | None = None) -> Registry:
    """The built-in factors with the given windows."""
    s = settings or FactorSettings()
    r = Registry()

    def add(name, fn, category, requires=("close",), periods=1, kind="technical", outputs=(), lookahead=False):
        if name not in s.disabled:
            r.add(Factor(name, fn, requires, periods, kind, category, lookahead, outputs))

    for n in s.sma:
        add(f"sma_{n}", lambda d, n=n: T.sma(d, n), "trend", periods=n)
    for n in s.ema:
        add(f"ema_{n}", lambda d, n=n: T.ema(d, n), "trend")
    add("macd", T.macd, "trend", outputs=("macd", "macd_signal", "macd_histogram"))
    for n in (20, 60):
        add(f"price_to_sma{n}", lambda d, n=n: T.price_to_sma(d, n), "trend", periods=n)
    for n in s.rsi:
        add(f"rsi_{n}", lambda d, n=n: T.rsi(d, n), "momentum", periods=n)
    add(f"williams_r_{s.williams}", lambda d: T.williams_r(d, s.williams), "momentum", ("high", "low", "close"), s.williams)
    add("stochastic", T.stochastic, "momentum", ("high", "low", "close"), 14, outputs=("stoch_k", "stoch_d"))
    for n in s.momentum:
        add(f"momentum_{n}", lambda d, n=n: T.momentum(d, n), "momentum", periods=n + 1)
        add(f"roc_{n}", lambda d, n=n: T.roc(d, n), "momentum", periods=n + 1)
    for n in s.volatility:
        add(f"volatility_{n}", lambda d, n=n: T.volatility(d, n), "volatility", periods=n + 1)
    add(f"atr_{s.atr}", lambda d: T.atr(d, s.atr), "volatility", ("high", "low", "close"), s.atr)
    add(
        "bollinger",
        lambda d: T.bollinger(d, s.bollinger, s.bollinger_sds),
        "volatility",
        periods=s.bollinger,
        outputs=("bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_position"),
    )
    for n in s.volume:
        add(f"volume_sma_{n}", lambda d, n=n: T.volume_sma(d, n), "volume", ("vol",), n)
        add(f"volume_ratio_{n}", lambda d, n=n: T.volume_ratio(d, n), "volume", ("vol",), n)
    add("vpt", T.volume_price_trend, "volume", ("close", "vol"))
    add(f"mfi_{s.mfi}", lambda d: T.mfi(d, s.mfi), "volume", ("high", "low", "close", "vol"), s.mfi)

    def mood(name, fn, requires, outputs, category):
        ahead = any(o in S.LOOKAHEAD for o in outputs)
        add(name, fn, category, requires, 1, "sentiment", outputs, ahead)

    for n in s.money_flow:
        mood(f"money_flow_{n}", lambda d, n=n: S.money_flow(d, n), ("amount",), (f"money_flow_{n}",), "money_flow")
    mood("net_inflow_rate", S.net_inflow_rate, ("close", "pre_close", "amount"), ("net_inflow_rate",), "money_flow")
    mood("order_ratios", S.order_ratios, ("amount", "vol"), ("big_order_ratio", "medium_order_ratio", "small_order_ratio"), "money_flow")
    mood("volume_price_trend", S.volume_price_agreement, ("close", "vol"), ("volume_price_trend",), "money_flow")
    mood(
        "attention",
        S.attention,
        ("vol", "high", "low", "close"),
        ("turnover_attention", "volume_attention", "price_attention", "attention_score", "attention_change_rate"),
        "attention",
    )
    mood(
        "strength",
        S.strength,
        ("close",),
        ("price_momentum_sentiment", "volatility_sentiment", "sentiment_strength", "sentiment_volatility"),
        "strength",
    )
    mood("bull_bear", S.bull_bear, ("close",), ("bullish_ratio", "bearish_ratio"), "strength")
    mood("tone", S.tone, ("close",), ("sentiment_intensity", "sentiment_consistency", "sentiment_momentum"), "news")
    mood("abnormal", S.abnormal, ("close", "vol"), ("abnormal_volume", "abnormal_return"), "event")
    mood("event_signals", S.event_signals, ("open", "close", "pre_close", "vol"), ("price_limit_signal", "gap_signal", "volume_spike"), "event")

    def report(name, fn, requires, outputs):
        add(name, fn, name, requires, 1, "fundamental", outputs)

    report("ttm", Fu.with_ttm, ("net_profit", "revenue", "operating_cash_flow", "ebitda"), ("net_profit_ttm", "revenue_ttm", "operating_cash_flow_ttm", "ebitda_ttm"))
    report("growth", Fu.growth, ("revenue", "net_profit"), ("revenue_yoy", "revenue_qoq", "net_profit_yoy", "net_profit_qoq", "revenue_cagr_3y", "net_profit_cagr_3y"))
    report(
        "profitability",
        Fu.profitability,
        ("net_profit", "total_assets", "revenue", "oper_cost", "operate_profit", "total_cur_liab", Fu.EQUITY),
        ("roe", "roa", "roic", "gross_margin", "net_margin", "operating_margin"),
    )
    report(
        "soundness",
        Fu.soundness,
        ("total_liab", "total_cur_assets", "total_cur_liab", "inventories", "money_cap", "revenue", "total_assets", "operate_profit", "fin_exp", Fu.EQUITY),
        ("debt_to_equity", "current_ratio", "quick_ratio", "cash_ratio", "asset_turnover", "interest_coverage"),
    )
    return r


class Statistic:
    """A user's statistic of a group, from states that parts of the group give and that merge.

    ``update`` takes a part of a group as a pandas frame and gives its state, ``merge`` puts two
    states together in any order, and ``finish`` gives the result's values by name. States are
    bytes of bounded size, whatever the group's.
    """

    schema: str

    def update(self, rows: pd.DataFrame) -> bytes:
        raise NotImplementedError

    def merge(self, a: bytes, b: bytes) -> bytes:
        raise NotImplementedError

    def finish(self, state: bytes) -> dict:
        raise NotImplementedError


#: Groups whose states a task holds before it hands them on, and parts that a hot group's states are merged in.
HELD_STATES, MERGE_PARTS = 20_000, 64


def grouped_statistic(df: DataFrame, by: list[str], columns: list[str], statistic: Statistic) -> DataFrame:
    """(by, the statistic's columns) for each group; no task is handed a group whole.

    Each task keeps one state a group over its batches; states, not rows, are shuffled and merged,
    first in parts by chance and then to one.
    """
    rows = df.select(*by, *columns)
    keys = [f for f in rows.schema.fields if f.name in by]
    with_state = StructType([*keys, StructField("state", BinaryType())])
    grouped = lambda pdf: pdf.groupby(by, dropna=False, sort=False)
    as_key = lambda key: tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))

    def states(batches):
        held: dict[tuple, bytes] = {}

        def out():
            frame = pd.DataFrame([(*k, s) for k, s in held.items()], columns=[*by, "state"])
            held.clear()
            return frame

        for batch in batches:
            for key, part in grouped(batch):
                key, state = as_key(key), statistic.update(part)
                held[key] = statistic.merge(held[key], state) if key in held else state
            if len(held) >= HELD_STATES:
                yield out()
        if held:
            yield out()

    def merged(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key[: len(by)], functools.reduce(statistic.merge, pdf["state"]))], columns=[*by, "state"])

    def finished(key, pdf: pd.DataFrame) -> pd.DataFrame:
        values = statistic.finish(functools.reduce(statistic.merge, pdf["state"]))
        return pd.DataFrame([{**dict(zip(by, key)), **values}])

    parts = rows.mapInPandas(states, with_state).withColumn("_part", F.pmod(F.xxhash64("state"), F.lit(MERGE_PARTS)))
    fewer = parts.groupBy(*by, "_part").applyInPandas(merged, with_state)
    result = StructType([*keys, *StructType.fromDDL(statistic.schema).fields])
    return fewer.groupBy(*by).applyInPandas(finished, result)


class HalfSampleMode(Statistic):
    """The mode of a number by halving: of all spans that hold half of the values the shortest, and again inside it.

    The state is a histogram of ``digits`` decimal places, so the result is exact to these and the
    state is as large as the distinct rounded values at most. Nulls and non-finite values don't count.
    """

    schema = "mode double, n long"

    def __init__(self, column: str, digits: int = 3):
        self.column, self.scale = column, 10**digits

    def update(self, rows: pd.DataFrame) -> bytes:
        x = rows[self.column].to_numpy(float)
        x = x[np.isfinite(x)]
        bins, counts = np.unique(np.round(x * self.scale).astype(np.int64), return_counts=True)
        return np.stack([bins, counts.astype(np.int64)]).tobytes()

    def merge(self, a: bytes, b: bytes) -> bytes:
        both = np.hstack([np.frombuffer(s, np.int64).reshape(2, -1) for s in (a, b)])
        bins, at = np.unique(both[0], return_inverse=True)
        counts = np.zeros(len(bins), np.int64)
        np.add.at(counts, at, both[1])
        return np.stack([bins, counts]).tobytes()

    def finish(self, state: bytes) -> dict:
        bins, counts = np.frombuffer(state, np.int64).reshape(2, -1)
        total = int(counts.sum())
        if not total:
            return {"mode": None, "n": 0}
        # Values stand in order; first and last place of the span that is left.
        upto = np.cumsum(counts)
        low, high = 0, total - 1
        while high > low:
            half = (high - low + 2) // 2
            # Spans that begin where a value begins are enough, and the span's begin.
            starts = np.unique(np.clip(np.r_[low, upto], low, high - half + 1))
            value = lambda place: bins[np.searchsorted(upto, place, side="right")]
            k = int(np.argmin(value(starts + half - 1) - value(starts)))
            if (low, high) == (int(starts[k]), int(starts[k]) + half - 1):
                break
            low, high = int(starts[k]), int(starts[k]) + half - 1
            if value(np.array([low]))[0] == value(np.array([high]))[0]:
                break
        ends = bins[np.searchsorted(upto, np.array([low, high]), side="right")]
        return {"mode": float(ends.sum()) / 2 / self.scale, "n": total}
