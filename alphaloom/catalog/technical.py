"""Technical factor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.catalog.base import W, joined, query, roll, view
from alphaloom.operators import crosssection as X
from alphaloom.operators import technical as T
from alphaloom.sources.tables import bars

KEYS = "ts_code trade_date"
C = '"close"'


def _over(fn):
    return lambda spark, folder: fn(bars(spark, folder))


def _each(fn, *ns):
    def run(df):
        for n in ns:
            df = fn(df, n)
        return df

    return _over(run)


def _select(exprs: dict[str, str], source: str = "bars") -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    return f"SELECT ts_code, trade_date, {cols} FROM {source}"


def _lag(x, n=1):
    return f"lag({x}, {n}) OVER ({W})"


def _simple(name, fn, exprs, source="bars", digits=6):
    query(name, KEYS, list(exprs), _select(exprs, source), needs=(source,) if source.isidentifier() else ("bars", "rets"), digits=digits)(fn)


_simple("technical_sma", _each(T.sma, 5, 10, 20, 60), {f"sma_{n}": roll("avg", C, n) for n in (5, 10, 20, 60)})
_simple("technical_momentum", _each(T.momentum, 5, 10, 20), {f"momentum_{n}": f"{C} - {_lag(C, n)}" for n in (5, 10, 20)}, digits=8)
_simple("technical_roc", _each(T.roc, 5, 10, 20), {f"roc_{n}": f"({C} / nullif({_lag(C, n)}, 0) - 1) * 100" for n in (5, 10, 20)})
_simple(
    "technical_price_to_sma",
    _each(T.price_to_sma, 20, 60),
    {f"price_to_sma{n}": f"{C} / nullif({roll('avg', C, n)}, 0)" for n in (20, 60)},
)
_simple(
    "technical_volatility",
    _each(T.volatility, 5, 20, 60),
    {f"volatility_{n}": f"({roll('stddev_samp', 'ret', n)}) * sqrt(252)" for n in (5, 20, 60)},
    "rets",
)
_simple("technical_volume_sma", _each(T.volume_sma, 5, 20), {f"volume_sma_{n}": roll("avg", "vol", n) for n in (5, 20)})
_simple(
    "technical_volume_ratio",
    _each(T.volume_ratio, 5, 20),
    {f"volume_ratio_{n}": f"vol / nullif({roll('avg', 'vol', n)}, 0)" for n in (5, 20)},
)
_hh, _ll = roll("max", "high", 14), roll("min", "low", 14)
_simple("technical_williams_r", _over(T.williams_r), {"williams_r_14": f"-100 * ((({_hh}) - {C}) / nullif(({_hh}) - ({_ll}), 0))"})

query(
    "technical_stochastic",
    KEYS,
    "stoch_k stoch_d",
    f"""SELECT *, {roll('avg', 'stoch_k', 3)} AS stoch_d FROM (
        SELECT ts_code, trade_date, 100 * (({C} - ({_ll})) / nullif(({_hh}) - ({_ll}), 0)) AS stoch_k FROM bars)""",
)(_over(T.stochastic))

query(
    "technical_atr",
    KEYS,
    "atr_14",
    f"""SELECT ts_code, trade_date, {roll('avg', 'tr', 14)} AS atr_14 FROM (
        SELECT *, greatest(high - low, coalesce(abs(high - pre_close), 0), coalesce(abs(low - pre_close), 0)) AS tr FROM bars)""",
)(_over(T.atr))

query(
    "technical_bollinger",
    KEYS,
    "bb_upper bb_middle bb_lower bb_width bb_position",
    f"""SELECT *, (bb_upper - bb_lower) / nullif(bb_middle, 0) AS bb_width,
               (c - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_position FROM (
        SELECT ts_code, trade_date, {C} AS c, m AS bb_middle, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower FROM (
            SELECT *, {roll('avg', C, 20)} AS m, {roll('stddev_samp', C, 20)} AS s FROM bars))""",
)(_over(T.bollinger))

query(
    "technical_vpt",
    KEYS,
    "vpt",
    f"""SELECT ts_code, trade_date, CASE WHEN vol * ret IS NOT NULL
               THEN sum(vol * ret) OVER ({W} ROWS UNBOUNDED PRECEDING) END AS vpt FROM rets""",
    needs=("rets",),
    digits=3,
)(_over(T.volume_price_trend))

_RSI = """SELECT ts_code, trade_date, {cols} FROM (
    SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM (
        SELECT *, coalesce("close" - lag("close") OVER (PARTITION BY ts_code ORDER BY trade_date), 0) AS d FROM bars))"""


def _rsi_expr(n):
    u, d = roll("avg", "up", n), roll("avg", "dn", n)
    return f"CASE WHEN ({d}) = 0 THEN CASE WHEN ({u}) > 0 THEN 100 END ELSE 100 - 100 / (1 + ({u}) / ({d})) END"


query("technical_rsi", KEYS, "rsi_6 rsi_14", _RSI.format(cols=f"{_rsi_expr(6)} AS rsi_6, {_rsi_expr(14)} AS rsi_14"))(_each(T.rsi, 6, 14))

_sp, _sn = roll("sum", "pos", 14), roll("sum", "neg", 14)
query(
    "technical_mfi",
    KEYS,
    "mfi_14",
    f"""SELECT ts_code, trade_date, CASE WHEN ({_sn}) = 0 THEN CASE WHEN ({_sp}) > 0 THEN 100 END
               ELSE 100 - 100 / (1 + ({_sp}) / ({_sn})) END AS mfi_14 FROM (
        SELECT *, CASE WHEN tp > prev THEN tp * vol ELSE 0 END AS pos, CASE WHEN tp < prev THEN tp * vol ELSE 0 END AS neg FROM (
            SELECT *, lag(tp) OVER ({W}) AS prev FROM (SELECT *, (high + low + {C}) / 3 AS tp FROM bars)))""",
)(_over(T.mfi))

# The SQL side states the definition directly: every earlier row with its weight.
view("numbered", f'SELECT ts_code, trade_date, "close" AS x, row_number() OVER ({W}) AS i FROM bars', "bars")


def _ema_sql(source, span):
    r = 1 - 2 / (span + 1)
    return f"""SELECT a.ts_code, a.trade_date, a.i, sum(b.x * pow({r!r}, a.i - b.i)) / sum(pow({r!r}, a.i - b.i)) AS x
               FROM {source} a JOIN {source} b ON a.ts_code = b.ts_code AND b.i <= a.i GROUP BY 1, 2, 3"""


view("ema12", _ema_sql("numbered", 12), "numbered")
view("ema26", _ema_sql("numbered", 26), "numbered")
view("macd_line", "SELECT ts_code, trade_date, i, a.x - b.x AS x FROM ema12 a JOIN ema26 b USING (ts_code, trade_date, i)", "ema12", "ema26")
view("macd_sig", _ema_sql("macd_line", 9), "macd_line")

query(
    "technical_ema",
    KEYS,
    "ema_12 ema_26",
    "SELECT ts_code, trade_date, a.x AS ema_12, b.x AS ema_26 FROM ema12 a JOIN ema26 b USING (ts_code, trade_date)",
    needs=("ema12", "ema26"),
    digits=4,
)(_each(T.ema, 12, 26))

query(
    "technical_macd",
    KEYS,
    "macd macd_signal macd_histogram",
    """SELECT ts_code, trade_date, a.x AS macd, b.x AS macd_signal, a.x - b.x AS macd_histogram
       FROM macd_line a JOIN macd_sig b USING (ts_code, trade_date)""",
    needs=("macd_line", "macd_sig"),
)(_over(T.macd))

query(
    "technical_min_history",
    "ts_code",
    "",
    "SELECT ts_code FROM bars GROUP BY ts_code HAVING count(*) >= 520",
)(_over(lambda df: T.with_min_history(df, 520).select("ts_code").distinct()))

query(
    "technical_compat_calls",
    KEYS,
    "rsi sma bb_upper",
    f"""SELECT ts_code, trade_date, {_rsi_expr(14)} AS rsi, {roll('avg', C, 20)} AS sma,
               ({roll('avg', C, 20)}) + 2 * ({roll('stddev_samp', C, 20)}) AS bb_upper FROM (
        SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM (
            SELECT *, coalesce({C} - pre_close, 0) AS d FROM bars))""",
)(_over(lambda df: T.calculate_bollinger_bands(T.calculate_sma(T.calculate_rsi(df)))))

view("ema20", _ema_sql("numbered", 20), "numbered")
query(
    "technical_compat_averages",
    KEYS,
    "macd macd_signal macd_histogram ema",
    """SELECT ts_code, trade_date, a.x AS macd, b.x AS macd_signal, a.x - b.x AS macd_histogram, c.x AS ema
       FROM macd_line a JOIN macd_sig b USING (ts_code, trade_date) JOIN ema20 c USING (ts_code, trade_date)""",
    needs=("macd_line", "macd_sig", "ema20"),
    digits=4,
)(_over(lambda df: T.calculate_ema(T.calculate_macd(df))))

# The wide table of all factors holds the same values as the single queries.
query(
    "technical_all_factors",
    KEYS,
    {"sma_60": 6, "rsi_14": 6, "macd_histogram": 6, "mfi_14": 6, "bb_position": 6, "williams_r_14": 6, "vpt": 3},
    joined("technical_sma", "technical_rsi", "technical_macd", "technical_mfi", "technical_bollinger", "technical_williams_r", "technical_vpt"),
    (),
)(_over(T.technical_factors))

_z = "(x - avg(x) OVER (PARTITION BY f)) / nullif(stddev_samp(x) OVER (PARTITION BY f), 0)"
query(
    "technical_outlier_counts",
    "factor_name n_values n_outliers",
    "",
    f"""SELECT f AS factor_name, count(*) AS n_values, count(*) FILTER (abs(z) > 3) AS n_outliers FROM (
        SELECT f, {_z} AS z FROM (
            SELECT 'roc_5' AS f, ({C} / nullif({_lag(C, 5)}, 0) - 1) * 100 AS x FROM bars
            UNION ALL SELECT 'volume_ratio_5', vol / nullif({roll('avg', 'vol', 5)}, 0) FROM bars) WHERE x IS NOT NULL) GROUP BY f""",
)(_over(lambda df: T.outlier_counts(T.volume_ratio(T.roc(df, 5), 5), ["roc_5", "volume_ratio_5"])))

view(
    "flagship",
    f"""SELECT ts_code, trade_date, sma_20, rsi_14, roc_5,
               (roc_5 - avg(roc_5) OVER d) / nullif(stddev_samp(roc_5) OVER d, 0) AS score FROM (
          SELECT ts_code, trade_date, {roll('avg', C, 20)} AS sma_20, {_rsi_expr(14)} AS rsi_14,
                 ({C} / nullif({_lag(C, 5)}, 0) - 1) * 100 AS roc_5 FROM (
            SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM (SELECT *, coalesce({C} - pre_close, 0) AS d FROM bars)))
        WINDOW d AS (PARTITION BY trade_date)""",
    "bars",
)


@query(
    "momentum_leaders",
    "ts_code trade_date rank",
    "sma_20 rsi_14 roc_5 score",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) AS rank
       FROM flagship WHERE score IS NOT NULL) WHERE rank <= 10""",
    needs=("flagship",),
)
def momentum_leaders(spark, folder):
    """Daily ten best securities by standardised five-day change, with trend and strength."""
    df = T.roc(T.rsi(T.sma(bars(spark, folder), 20), 14), 5)
    df = X.group_stats(df.where(F.col("roc_5").isNotNull()), "trade_date", m=F.avg("roc_5"), s=F.stddev_samp("roc_5"))
    df = df.withColumn("score", F.try_divide(F.col("roc_5") - F.col("m"), F.col("s"))).where(F.col("score").isNotNull())
    return X.top_per_group(df, "trade_date", [F.desc("score"), F.asc("ts_code")], 10)
