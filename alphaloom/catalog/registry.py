"""Factor registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

import alphaloom.catalog.panel  # noqa: F401
from alphaloom.catalog.base import joined, query, roll
from alphaloom.operators import technical as T
from alphaloom.plans import registry as G
from alphaloom.sources.tables import bars, panel, statements

C = '"close"'


def _with_custom():
    r = G.default_registry(G.FactorSettings.of('{"sma": [3, 8], "disabled": ["vpt"]}'))

    @r.factor("range_share", requires=("high", "low"), category="volatility")
    def range_share(df):
        return df.withColumn("range_share", F.try_divide(F.col("high") - F.col("low"), F.col("high")))

    return r


query(
    "registry_compute",
    "ts_code trade_date",
    {"sma_3": 8, "sma_8": 4, "range_share": 8},
    f"SELECT ts_code, trade_date, {roll('avg', C, 3)} AS sma_3, {roll('avg', C, 8)} AS sma_8, (high - low) / nullif(high, 0) AS range_share FROM bars",
)(lambda s, f: _with_custom().compute(bars(s, f), ["sma_3", "sma_8", "range_share"]))
query("registry_short_histories", "ts_code n", "", "SELECT ts_code, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) >= 520")(
    lambda s, f: _long_only(s, f)
)


def _long_only(spark, folder):
    r = G.Registry()
    r.add(G.Factor("slow", lambda d: T.sma(d, 520, out="slow"), min_periods=520))
    return r.compute(bars(spark, folder), ["slow"], keep_short=False).groupBy("ts_code").agg(F.count("*").alias("n"))


query(
    "registry_fundamental",
    "ts_code end_date",
    "roe current_ratio revenue_yoy",
    joined("fundamental_growth", "fundamental_profitability", "fundamental_soundness", using="ts_code, end_date"),
    (),
)(
    lambda s, f: G.default_registry().compute(statements(s, f), ["growth", "profitability", "soundness"])
)


query("user_statistic", "ts_code n", {"span": 6}, "SELECT ts_code, max(rng) - min(rng) AS span, count(rng) AS n FROM panel GROUP BY 1", ("panel",))(
    lambda s, f: panel(s, f).groupBy("ts_code").agg((F.max("rng") - F.min("rng")).alias("span"), F.count("rng").alias("n"))
)
query("user_half_sample_mode", "ts_code n", {"mode": 4})(lambda s, f: G.grouped_statistic(panel(s, f), ["ts_code"], ["rng"], G.HalfSampleMode("rng")))
