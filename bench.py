"""Headline queries at one scale; prints one JSON line.

Every query runs to a no-op sink, so the whole result is computed. The stored bars and panel are
built once per session, as a user keeps them, and timed on their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

from alphaloom.catalog import QUERIES
from alphaloom.session import local_session
from alphaloom.sources import tables

HEADLINE = (
    "technical_sma",
    "technical_rsi",
    "technical_ema",
    "technical_macd",
    "technical_bollinger",
    "technical_all_factors",
    "fundamental_growth",
    "fundamental_valuation",
    "sentiment_attention",
    "sentiment_all_factors",
    "momentum_leaders",
    "winsorize_quantile",
    "standardize_zscore",
    "standardize_normal_scores",
    "neutralize_cap_industry",
    "processed_factors",
    "market_quantiles",
    "industry_rank",
    "information_coefficient",
    "layered_backtest",
    "factor_decay",
    "correlation_spearman",
    "stock_scores",
    "score_rankings",
    "industry_balanced_stocks",
    "strategy_backtest",
    "strategy_evaluation",
    "quality_score",
    "quality_rules",
    "clean_prices",
    "factor_statistics",
    "missing_days",
    "incremental_factors",
    "feature_values",
    "data_drift",
    "model_linear",
    "stream_window_stats",
    "stream_alerts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    for name in ("bars", "statements", "panel"):
        timed(f"build_{name}", lambda n=name: getattr(tables, n)(spark, folder))
    for name in wanted:
        timed(name, lambda n=name: QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
