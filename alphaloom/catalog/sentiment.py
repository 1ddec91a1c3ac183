"""Sentiment factor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.catalog.base import W, joined, query, roll, view
from alphaloom.operators import sentiment as S
from alphaloom.sources.tables import bars, daily_basic, table

KEYS = "ts_code trade_date"
C = '"close"'


def _band(x, lo, hi, op=">"):
    return f"CASE WHEN ({x}) {op} {lo} AND ({x}) < {hi} THEN ({x}) END"


def _over(fn):
    return lambda spark, folder: fn(bars(spark, folder))


def _flow(n):
    return f"(mf{n} / nullif(lag(mf{n}, {n}) OVER ({W}), 0) - 1) * 100"


query(
    "sentiment_money_flow",
    KEYS,
    "money_flow_5 money_flow_20",
    f"""SELECT ts_code, trade_date, {_band(_flow(5), -1000, 1000)} AS money_flow_5, {_band(_flow(20), -1000, 1000)} AS money_flow_20
        FROM (SELECT *, {roll('avg', 'amount', 5)} AS mf5, {roll('avg', 'amount', 20)} AS mf20 FROM bars)""",
)(_over(lambda df: S.money_flow(S.money_flow(df, 5), 20)))

query(
    "sentiment_net_inflow_rate",
    KEYS,
    "net_inflow_rate",
    f"SELECT ts_code, trade_date, {_band(f'({C} - pre_close) / nullif(pre_close, 0) * amount / nullif(amount, 0) * 100', -100, 100)} AS net_inflow_rate FROM bars",
)(_over(S.net_inflow_rate))

query(
    "sentiment_order_ratios",
    KEYS,
    "big_order_ratio medium_order_ratio small_order_ratio",
    f"""SELECT *, (50 - abs(big_order_ratio)) / 2 AS medium_order_ratio,
               50 - abs(big_order_ratio) - (50 - abs(big_order_ratio)) / 2 AS small_order_ratio FROM (
          SELECT ts_code, trade_date, {_band(f"(ap / nullif({roll('avg', 'ap', 20)}, 0) - 1) * 100", -50, 50)} AS big_order_ratio
          FROM (SELECT *, amount / nullif(vol, 0) AS ap FROM bars))""",
)(_over(S.order_ratios))

query(
    "sentiment_volume_price_trend",
    KEYS,
    "volume_price_trend",
    f"""SELECT ts_code, trade_date, ({roll('avg', 'agree', 5)}) * 100 AS volume_price_trend FROM (
        SELECT *, sign({C} / lag({C}) OVER ({W}) - 1) * sign(vol / lag(vol) OVER ({W}) - 1) AS agree FROM bars)""",
)(_over(S.volume_price_agreement))

view(
    "attention_parts",
    f"""SELECT ts_code, trade_date, {_band('turnover_rate', 0, 100, '>=')} AS turnover_attention,
               {_band(f"vol / nullif({roll('avg', 'vol', 20)}, 0)", 0, 20)} AS volume_attention,
               {_band(f'(high - low) / nullif({C}, 0) * 100', 0, 50, '>=')} AS price_attention FROM valued""",
    "valued",
)


def _norm(c):
    lo, hi = f"quantile_cont({c}, 0.05) OVER (PARTITION BY ts_code)", f"quantile_cont({c}, 0.95) OVER (PARTITION BY ts_code)"
    return f"CASE WHEN {hi} > {lo} THEN ({c} - {lo}) / ({hi} - {lo}) ELSE 0.5 END"


query(
    "sentiment_attention",
    KEYS,
    "turnover_attention volume_attention price_attention attention_score attention_change_rate",
    f"""SELECT *, {_band(f'(attention_score / nullif(lag(attention_score, 5) OVER ({W}), 0) - 1) * 100', -1000, 1000)} AS attention_change_rate FROM (
        SELECT *, (({_norm('turnover_attention')}) * 0.4 + ({_norm('volume_attention')}) * 0.4 + ({_norm('price_attention')}) * 0.2) * 100 AS attention_score
        FROM attention_parts)""",
    needs=("attention_parts",),
)(lambda spark, folder: S.attention(daily_basic(spark, folder)))

_P = "OVER (PARTITION BY ts_code)"
query(
    "sentiment_strength",
    KEYS,
    "price_momentum_sentiment volatility_sentiment sentiment_strength sentiment_volatility",
    f"""SELECT *, {roll('stddev_samp', 'sentiment_strength', 10)} AS sentiment_volatility FROM (
        SELECT ts_code, trade_date, pm AS price_momentum_sentiment, vs AS volatility_sentiment,
               (abs((pm - avg(pm) {_P}) / nullif(stddev_samp(pm) {_P}, 0)) * 0.6 + (vs - avg(vs) {_P}) / nullif(stddev_samp(vs) {_P}, 0) * 0.4) * 50 AS sentiment_strength
        FROM (SELECT *, {_band(f'({C} / nullif(lag({C}, 5) OVER ({W}), 0) - 1) * 100', -100, 100)} AS pm,
                     {_band(f"({roll('stddev_samp', 'ret', 20)}) * sqrt(252) * 100", 0, 200, '>=')} AS vs FROM rets))""",
    needs=("rets",),
)(_over(S.strength))

query(
    "sentiment_bull_bear",
    KEYS,
    "bullish_ratio bearish_ratio",
    f"""SELECT *, 100 - bullish_ratio AS bearish_ratio FROM (
        SELECT ts_code, trade_date, ({roll('avg', 'up', 20)}) * 100 AS bullish_ratio FROM (SELECT *, CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END AS up FROM rets))""",
    needs=("rets",),
)(_over(S.bull_bear))

query(
    "sentiment_tone",
    KEYS,
    "sentiment_intensity sentiment_consistency sentiment_momentum",
    f"""SELECT ts_code, trade_date, 1 - exp(-abs(sd5)) AS sentiment_intensity,
               CASE WHEN max(cs) {_P} > 0 THEN 1 - cs / max(cs) {_P} ELSE 0 END AS sentiment_consistency,
               CASE WHEN max(mm) {_P} <> min(mm) {_P} THEN (mm - min(mm) {_P}) / (max(mm) {_P} - min(mm) {_P}) ELSE 0.5 END AS sentiment_momentum FROM (
        SELECT ts_code, trade_date, {roll('stddev_samp', 'ret', 5)} AS sd5, {roll('stddev_pop', 'ret', 10)} AS cs,
               ({roll('avg', 'ret', 5)}) - ({roll('avg', 'ret', 20)}) AS mm FROM rets)""",
    needs=("rets",),
)(_over(S.tone))


def _abn(c):
    return _band(f"({c} - ({roll('avg', c, 20)})) / nullif({roll('stddev_samp', c, 20)}, 0)", -10, 10)


query(
    "sentiment_abnormal",
    KEYS,
    "abnormal_volume abnormal_return",
    f"SELECT ts_code, trade_date, {_abn('vol')} AS abnormal_volume, {_abn('ret')} AS abnormal_return FROM rets",
    needs=("rets",),
)(_over(S.abnormal))

query(
    "sentiment_event_signals",
    "ts_code trade_date price_limit_signal gap_signal volume_spike",
    "",
    f"""SELECT ts_code, trade_date,
        CAST(CASE WHEN m >= 9.5 THEN 1 WHEN m <= -9.5 THEN -1 ELSE 0 END AS INTEGER) AS price_limit_signal,
        CAST(CASE WHEN g >= 2 THEN 1 WHEN g <= -2 THEN -1 ELSE 0 END AS INTEGER) AS gap_signal,
        CAST(CASE WHEN b >= 2 THEN 1 ELSE 0 END AS INTEGER) AS volume_spike FROM (
          SELECT *, ({C} - pre_close) / nullif(pre_close, 0) * 100 AS m, (open - pre_close) / nullif(pre_close, 0) * 100 AS g,
                 vol / nullif({roll('avg', 'vol', 5)}, 0) AS b FROM bars)""",
)(_over(S.event_signals))


def news_feed(spark, folder):
    """Review tone per order line stands in for news: return flag as source, discount as score."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("ts_code"),
        F.to_date("l_shipdate").alias("news_date"),
        F.col("l_returnflag").alias("source"),
        (F.lit(1.0) - F.col("l_discount") * 20).alias("sentiment_score"),
    )


query(
    "sentiment_news_score",
    KEYS,
    "news_sentiment_score",
    """SELECT ts_code, trade_date, news_sentiment_score FROM bars LEFT JOIN (
         SELECT l_suppkey AS ts_code, CAST(l_shipdate AS DATE) AS trade_date, avg(1.0 - l_discount * 20) AS news_sentiment_score
         FROM lineitem GROUP BY 1, 2) USING (ts_code, trade_date)""",
)(lambda spark, folder: S.news_score(bars(spark, folder), news_feed(spark, folder)))

query(
    "sentiment_all_factors",
    KEYS,
    "money_flow_5 sentiment_strength abnormal_return sentiment_momentum attention_score news_sentiment_score",
    joined("sentiment_money_flow", "sentiment_strength", "sentiment_abnormal", "sentiment_tone", "sentiment_attention", "sentiment_news_score"),
    (),
)(lambda spark, folder: S.sentiment_factors(daily_basic(spark, folder), news_feed(spark, folder)))
