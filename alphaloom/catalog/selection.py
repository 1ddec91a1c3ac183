"""Scoring, selection, portfolio and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

import alphaloom.catalog.panel  # noqa: F401
from alphaloom.catalog.base import W, cells, query, view
from alphaloom.operators import evaluation as V
from alphaloom.operators import joins as J
from alphaloom.operators import portfolio as Po
from alphaloom.operators import preprocess as P
from alphaloom.operators import scoring as R
from alphaloom.operators import crosssection as X
from alphaloom.sources.tables import bars, panel, stock_basic, table

FACTORS = ["mom", "volr", "rng"]
WEIGHTS = {"mom": 0.5, "volr": 0.3, "rng": 0.2}
D = "OVER (PARTITION BY trade_date)"

# ---- scores -------------------------------------------------------------------------------


def scores(spark, folder):
    """Weighted scores of every security and day, normalised over the market of the day."""
    return R.weighted_score(P.scoring_normalize(panel(spark, folder), FACTORS, "zscore", "trade_date"), WEIGHTS)


def ranked(spark, folder):
    return R.rankings(scores(spark, folder))


def _n(c):
    return f"""CASE WHEN {c} IS NOT NULL THEN greatest(least(CASE WHEN stddev_samp({c}) {D} > 0
               THEN ({c} - avg({c}) {D}) / stddev_samp({c}) {D} ELSE {c} END, 3), -3) END AS n_{c}"""


view(
    "scores",
    f"""SELECT *, round(100 / (1 + exp(-weighted_score)), 8) AS score FROM (
        SELECT *, round(coalesce(n_mom * 0.5, 0) + coalesce(n_volr * 0.3, 0) + coalesce(n_rng * 0.2, 0), 10) AS weighted_score
        FROM (SELECT *, {_n('mom')}, {_n('volr')}, {_n('rng')} FROM panel))""",
    "panel",
)
view(
    "placed",
    """SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, ts_code) AS rank_overall,
              row_number() OVER (PARTITION BY trade_date, industry ORDER BY score DESC, ts_code) AS industry_rank FROM scores""",
    "scores",
)
query("stock_scores", "ts_code trade_date", {"weighted_score": 10, "score": 8}, "SELECT * FROM scores", ("scores",))(scores)
query("score_rankings", "ts_code trade_date rank_overall industry_rank", {"score": 8}, "SELECT * FROM placed", ("placed",))(ranked)
query(
    "stored_scores",
    "ts_code industry",
    {"score": 8},
    "SELECT * FROM scores WHERE trade_date = DATE '1998-06-15' AND industry = 'ASIA' ORDER BY score DESC, ts_code LIMIT 20",
    ("scores",),
)(lambda s, f: R.stored_scores(scores(s, f), "1998-06-15", "ASIA", 20))
query(
    "top_stocks",
    "ts_code trade_date rank",
    {"score": 8},
    "SELECT *, rank_overall AS rank FROM placed WHERE rank_overall <= 10 AND score >= 60",
    ("placed",),
)(lambda s, f: R.top_stocks(scores(s, f), 10, 60.0))
query(
    "industry_balanced_stocks",
    "ts_code trade_date industry rank",
    {"score": 8},
    """SELECT p.*, p.industry_rank AS rank FROM placed p JOIN (
         SELECT trade_date, industry, count(*) OVER (PARTITION BY trade_date) AS k,
                row_number() OVER (PARTITION BY trade_date ORDER BY best DESC, industry) - 1 AS i
         FROM (SELECT trade_date, industry, max(score) AS best FROM scores GROUP BY 1, 2)) g USING (trade_date, industry)
       WHERE p.industry_rank <= greatest(1, 7 // k) + CASE WHEN i < 7 % k THEN 1 ELSE 0 END""",
    ("placed",),
)(lambda s, f: R.industry_balanced(scores(s, f), 7))


def report_days(spark, folder):
    """Every thirtieth day from the end of the data's first month of days to its last day."""
    ends = bars(spark, folder).agg(F.date_add(F.min("trade_date"), 30).alias("a"), F.max("trade_date").alias("b"))
    return ends.where("a <= b").select(F.explode(F.expr("sequence(a, b, INTERVAL 30 DAY)")).alias("report_date"))


query(
    "score_statistics",
    "ts_code report_date score_trend",
    {"avg_score_30d": 4, "std_score_30d": 5, "max_score_30d": 8, "min_score_30d": 8, "avg_rank_30d": 5},
    """SELECT *, CASE WHEN avg_score_30d > prev THEN 'up' WHEN avg_score_30d < prev THEN 'down' ELSE 'stable' END AS score_trend FROM (
         SELECT *, lag(avg_score_30d) OVER (PARTITION BY ts_code ORDER BY report_date) AS prev FROM (
           SELECT ts_code, report_date, avg(score) AS avg_score_30d, stddev_samp(score) AS std_score_30d, max(score) AS max_score_30d,
                  min(score) AS min_score_30d, avg(rank_overall) AS avg_rank_30d
           FROM placed JOIN (SELECT CAST(unnest(generate_series((SELECT min(trade_date) + 30 FROM bars), (SELECT max(trade_date) FROM bars), INTERVAL 30 DAY)) AS DATE) AS report_date)
             ON trade_date BETWEEN report_date - 30 AND report_date GROUP BY 1, 2))""",
    ("placed", "bars"),
)(lambda s, f: R.score_statistics(ranked(s, f), report_days(s, f)))

# ---- factor weights -----------------------------------------------------------------------


def importance(spark, folder):
    """Yearly factor importance: size of the factor's correlation with returns, per model (year)."""
    wide = panel(spark, folder).withColumn("model_name", F.date_format("trade_date", "yyyy")).groupBy("model_name")
    from alphaloom.functions.stats import correlation

    row = wide.agg(*[F.abs(correlation(c, "return_1d")).alias(c) for c in FACTORS])
    return row.unpivot(["model_name"], FACTORS, "factor_name", "importance")


def prior(spark, folder):
    """The year before, under this year's model name."""
    return importance(spark, folder).select(
        (F.col("model_name").cast("int") + 1).cast("string").alias("model_name"), "factor_name", F.col("importance").alias("weight")
    )


def new_weights(spark, folder):
    return R.derive_weights(importance(spark, folder), prior(spark, folder))


view(
    "importance",
    " UNION ALL ".join(
        f"SELECT strftime(trade_date, '%Y') AS model_name, '{c}' AS factor_name, abs(corr({c}, return_1d)) AS importance FROM panel GROUP BY 1" for c in FACTORS
    ),
    "panel",
)
view("prior", "SELECT CAST(CAST(model_name AS INTEGER) + 1 AS VARCHAR) AS model_name, factor_name, importance AS weight FROM importance", "importance")
view(
    "new_weights",
    """SELECT model_name, factor_name, w / sum(w) OVER (PARTITION BY model_name) AS weight FROM (
         SELECT i.model_name, i.factor_name, greatest(0.01, least(0.3, CASE WHEN p.weight IS NOT NULL THEN i.importance * 0.05 + p.weight * 0.95 ELSE i.importance END)) AS w
         FROM importance i LEFT JOIN prior p USING (model_name, factor_name))""",
    "importance",
    "prior",
)
query("factor_weights", "model_name factor_name", "weight", "SELECT * FROM new_weights", ("new_weights",))(new_weights)
query(
    "weight_stability",
    "model_name factor_name",
    "weight stability",
    """SELECT n.model_name, n.factor_name, n.weight, CASE WHEN p.weight IS NULL THEN 0.5 ELSE greatest(0, 1 - abs(n.weight - p.weight) / greatest(p.weight, 0.01)) END AS stability
       FROM new_weights n LEFT JOIN prior p USING (model_name, factor_name)""",
    ("new_weights", "prior"),
)(lambda s, f: R.weight_stability(new_weights(s, f), prior(s, f)))
query(
    "latest_weights",
    "model_name factor_name",
    "weight",
    "SELECT * FROM new_weights WHERE model_name = (SELECT max(model_name) FROM new_weights)",
    ("new_weights",),
)(lambda s, f: J.global_latest_rows(new_weights(s, f), "model_name"))


def change_log(spark, folder):
    return R.weight_changes(prior(spark, folder), new_weights(spark, folder)).withColumn("changed_at", F.col("model_name"))


view(
    "wlog",
    """SELECT *, new_weight - old_weight AS change FROM (SELECT model_name, factor_name, coalesce(p.weight, 0) AS old_weight, coalesce(n.weight, 0) AS new_weight
       FROM prior p FULL JOIN new_weights n USING (model_name, factor_name)) WHERE abs(new_weight - old_weight) > 0.001""",
    "new_weights",
    "prior",
)
query("weight_changes", "model_name factor_name", "old_weight new_weight change", "SELECT * FROM wlog", ("wlog",))(change_log)
query(
    "weight_history",
    "model_name factor_name",
    "new_weight",
    "SELECT * FROM wlog WHERE factor_name = 'mom' AND model_name >= '1997'",
    ("wlog",),
)(lambda s, f: R.weight_history(change_log(s, f), factor="mom", since="1997"))
query(
    "weight_history_stability",
    "factor_name change_count",
    "avg_change std_change max_change stability_score",
    """SELECT factor_name, count(*) AS change_count, avg(change) AS avg_change, coalesce(stddev_samp(change), 0) AS std_change, max(abs(change)) AS max_change,
              1 / (1 + avg(abs(change))) AS stability_score FROM wlog GROUP BY 1""",
    ("wlog",),
)(lambda s, f: R.weight_history_stability(change_log(s, f)))

# ---- holdings and signals -----------------------------------------------------------------


def latest_scores(spark, folder):
    return J.latest_row(scores(spark, folder).select("ts_code", "trade_date", "industry", "score", "close"), "ts_code", "trade_date")


def holdings(spark, folder):
    """Positions in well-funded securities, at their mean price, marked at the last close."""
    owned = stock_basic(spark, folder).where(F.col("acctbal") > 5000).select("ts_code", "industry")
    cost = bars(spark, folder).groupBy("ts_code").agg(
        F.avg("close").alias("avg_cost"), F.sum("vol").alias("shares"), F.datediff(F.max("trade_date"), F.min("trade_date")).alias("holding_days")
    )
    last = J.latest_row(bars(spark, folder).select("ts_code", "trade_date", "close"), "ts_code", "trade_date")
    return Po.mark_to_market(owned.join(cost, "ts_code"), last)


view("last_bar", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS rn FROM bars) WHERE rn = 1", "bars")
view("last_score", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS rn FROM scores) WHERE rn = 1", "scores")
view(
    "holdings",
    """SELECT ts_code, industry, avg_cost, shares, holding_days, l."close" AS current_price, shares * l."close" AS current_value,
              shares * l."close" - shares * avg_cost AS unrealized_pnl, (l."close" - avg_cost) / avg_cost AS unrealized_return
       FROM (SELECT ts_code, industry FROM basic WHERE acctbal > 5000) JOIN (
         SELECT ts_code, avg("close") AS avg_cost, sum(vol) AS shares, CAST(max(trade_date) - min(trade_date) AS INTEGER) AS holding_days FROM bars GROUP BY 1) USING (ts_code)
       JOIN last_bar l USING (ts_code)""",
    "basic",
    "last_bar",
)
query(
    "mark_to_market",
    "ts_code holding_days",
    {"current_price": 4, "current_value": 2, "unrealized_pnl": 1, "unrealized_return": 6},
    "SELECT * FROM holdings",
    ("holdings",),
)(holdings)
query(
    "exit_reasons",
    "ts_code sell_reason",
    "unrealized_return",
    """SELECT h.ts_code, unrealized_return, CASE WHEN unrealized_return <= -0.3 THEN 'stop_loss' WHEN unrealized_return >= 1.0 THEN 'take_profit'
              WHEN holding_days < 2450 THEN NULL WHEN s.score < 50 THEN 'score_drop' WHEN s.score IS NULL THEN 'not_scored' END AS sell_reason
       FROM holdings h LEFT JOIN (SELECT * FROM last_score WHERE score > 30) s USING (ts_code)""",
    ("holdings", "last_score"),
)(lambda s, f: Po.exit_reasons(holdings(s, f), latest_scores(s, f).where(F.col("score") > 30), 0.3, 1.0, 2450, 50.0))
query(
    "buy_candidates_top",
    "ts_code",
    {"score": 8},
    "SELECT ts_code, score FROM last_score ANTI JOIN holdings USING (ts_code) ORDER BY score DESC, ts_code LIMIT 10",
    ("holdings", "last_score"),
)(lambda s, f: Po.candidates(latest_scores(s, f), holdings(s, f), "top_score", 10))
query(
    "buy_candidates_threshold",
    "ts_code",
    {"score": 8},
    "SELECT ts_code, score FROM last_score ANTI JOIN holdings USING (ts_code) WHERE score >= 50",
    ("holdings", "last_score"),
)(lambda s, f: Po.candidates(latest_scores(s, f), holdings(s, f), "threshold", threshold=50.0))
query(
    "industry_capped_candidates",
    "ts_code industry",
    {"score": 8},
    """SELECT c.ts_code, c.industry, c.score FROM (SELECT * FROM last_score ANTI JOIN holdings USING (ts_code)) c
       LEFT JOIN (SELECT industry, sum(current_value) / (SELECT sum(current_value) FROM holdings) AS share FROM holdings GROUP BY 1) w USING (industry)
       WHERE coalesce(share, 0) < 0.2""",
    ("holdings", "last_score"),
)(lambda s, f: Po.under_industry_cap(J.not_held(latest_scores(s, f), holdings(s, f)), holdings(s, f), 0.2))
query(
    "held_scores",
    "ts_code",
    {"score": 8},
    "SELECT ts_code, score FROM last_score SEMI JOIN holdings USING (ts_code)",
    ("holdings", "last_score"),
)(lambda s, f: J.only_held(latest_scores(s, f), holdings(s, f)))
query(
    "order_sizing",
    "ts_code shares",
    {"amount": 4, "commission": 7},
    """SELECT ts_code, CAST(shares AS BIGINT) AS shares, shares * "close" AS amount, shares * "close" * 0.002 AS commission FROM (
         SELECT *, floor(least(10000000 * 0.1, 3000000 / 1.002) / "close" / 100) * 100 AS shares FROM last_bar) WHERE shares > 0""",
    ("last_bar",),
)(
    lambda s, f: Po.size_orders(
        J.latest_row(bars(s, f).select("ts_code", "trade_date", "close"), "ts_code", "trade_date").withColumnRenamed("close", "price"), 10_000_000, 3_000_000, 0.1, 0.002
    )
)
query(
    "rebalance_days",
    "trade_date is_rebalance held_since",
    "",
    """SELECT trade_date, is_rebalance, last_value(CASE WHEN is_rebalance THEN trade_date END IGNORE NULLS) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_since
       FROM (SELECT cal_date AS trade_date, dayofweek(cal_date) = 1 OR row_number() OVER (ORDER BY cal_date) = 1 AS is_rebalance FROM calendar)""",
    ("calendar",),
)(lambda s, f: Po.with_rebalance(days(s, f), "weekly"))


def days(spark, folder):
    return bars(spark, folder).select("trade_date").distinct()


query(
    "momentum_signals",
    "ts_code trade_date signal",
    {"price": 8, "momentum": 6},
    f"""SELECT ts_code, trade_date, "close" AS price, m AS momentum, CASE WHEN m > 0.05 THEN 'BUY' WHEN m < -0.05 THEN 'SELL' ELSE 'HOLD' END AS signal
        FROM (SELECT *, "close" / lag("close", 20) OVER ({W}) - 1 AS m FROM bars) WHERE m IS NOT NULL""",
)(lambda s, f: Po.momentum_signals(bars(s, f)))


def selection(spark, folder):
    return X.top_per_group(scores(spark, folder), "trade_date", [F.desc("score"), F.asc("ts_code")], 5)


query(
    "position_weights",
    "ts_code trade_date",
    "weight",
    "SELECT ts_code, trade_date, score / sum(score) OVER (PARTITION BY trade_date) AS weight FROM placed WHERE rank_overall <= 5",
    ("placed",),
)(lambda s, f: Po.position_weights(selection(s, f), "score_weighted"))
query(
    "factor_blend",
    "ts_code trade_date",
    "total_score",
    "SELECT ts_code, trade_date, mom * 0.4 + volr * 0.4 + rng * 0.2 AS total_score FROM panel",
    ("panel",),
)(lambda s, f: Po.blend(panel(s, f).withColumnsRenamed({"mom": "technical", "volr": "fundamental", "rng": "sentiment"})))
query(
    "portfolio_metrics",
    "trade_date num_stocks",
    "portfolio_return portfolio_risk sharpe_ratio",
    """SELECT *, (portfolio_return - 0.03) / nullif(portfolio_risk, 0) AS sharpe_ratio FROM (
         SELECT trade_date, count(*) AS num_stocks, sum(w * mom / 100) AS portfolio_return, sqrt(sum(pow(w * rng / 100, 2))) AS portfolio_risk FROM (
           SELECT *, 1.0 / count(*) OVER (PARTITION BY trade_date) AS w FROM placed WHERE rank_overall <= 5) GROUP BY 1)""",
    ("placed",),
)(lambda s, f: Po.portfolio_metrics(
    Po.position_weights(
        selection(s, f).drop("mom", "rng").join(panel(s, f).select("ts_code", "trade_date", (F.col("mom") / 100).alias("expected_return"), (F.col("rng") / 100).alias("expected_risk")), ["ts_code", "trade_date"])
    ),
    ["trade_date"],
))

# ---- portfolio returns and evaluation -------------------------------------------------------


def limited_returns(spark, folder):
    """Daily returns inside the ten percent price limit."""
    r = F.col("return_1d")
    return panel(spark, folder).select("ts_code", "trade_date", F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(0.1)), F.lit(-0.1))).alias("return_rate"))


def strategies(spark, folder):
    return panel(spark, folder).unpivot(["ts_code", "trade_date"], FACTORS, "strategy_id", "score")


def strategy_returns(spark, folder):
    return Po.backtest(strategies(spark, folder), limited_returns(spark, folder), days(spark, folder), 5, "monthly", 0.001)


view("limited", "SELECT ts_code, trade_date, CASE WHEN return_1d IS NOT NULL THEN greatest(least(return_1d, 0.1), -0.1) END AS r FROM panel", "panel")
view(
    "days",
    """SELECT *, last_value(CASE WHEN reb THEN trade_date END IGNORE NULLS) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_since FROM (
         SELECT cal_date AS trade_date, month(cal_date) <> month(cal_date - 1) OR row_number() OVER (ORDER BY cal_date) = 1 AS reb FROM calendar)""",
    "calendar",
)
view(
    "strat_scores",
    " UNION ALL ".join(f"SELECT '{c}' AS strategy_id, ts_code, trade_date, {c} AS score FROM panel WHERE {c} IS NOT NULL" for c in FACTORS),
    "panel",
)
view(
    "held",
    """SELECT *, 1.0 / count(*) OVER (PARTITION BY strategy_id, held_since) AS w FROM (
         SELECT strategy_id, ts_code, trade_date AS held_since, row_number() OVER (PARTITION BY strategy_id, trade_date ORDER BY score DESC, ts_code) AS rn
         FROM strat_scores WHERE trade_date IN (SELECT trade_date FROM days WHERE reb)) WHERE rn <= 5""",
    "strat_scores",
    "days",
)
view(
    "turnover",
    """SELECT strategy_id, held_since, sum(m) / 2 AS turnover FROM (SELECT strategy_id, held_since, ts_code, abs(sum(w)) AS m FROM (
         SELECT strategy_id, ts_code, held_since, w FROM held UNION ALL
         SELECT strategy_id, ts_code, nxt, -w FROM held JOIN (SELECT trade_date AS held_since, lead(trade_date) OVER (ORDER BY trade_date) AS nxt FROM days WHERE reb) USING (held_since) WHERE nxt IS NOT NULL)
       GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "held",
)
view(
    "bt",
    """SELECT strategy_id, trade_date, held_since, positions, gross, gross - CASE WHEN trade_date = first_day THEN coalesce(turnover, 0) * 0.001 ELSE 0 END AS r FROM (
         SELECT h.strategy_id, d.trade_date, h.held_since, count(*) AS positions, sum(w * coalesce(r, 0)) AS gross FROM held h JOIN days d ON h.held_since = d.held_since
         LEFT JOIN limited l ON l.ts_code = h.ts_code AND l.trade_date = d.trade_date GROUP BY 1, 2, 3)
       JOIN (SELECT held_since, min(trade_date) AS first_day FROM days WHERE held_since IS NOT NULL GROUP BY 1) USING (held_since) LEFT JOIN turnover USING (strategy_id, held_since)""",
    "held",
    "turnover",
    "limited",
)
query(
    "strategy_backtest",
    "strategy_id trade_date held_since positions",
    {"gross_return": 8, "return": 8},
    'SELECT *, gross AS gross_return, r AS "return" FROM bt',
    ("bt",),
)(strategy_returns)


def index_returns(spark, folder):
    """Equal-weight market return per day."""
    return limited_returns(spark, folder).where(F.col("return_rate").isNotNull()).groupBy("trade_date").agg(F.avg("return_rate").alias("return"))


view("idx", "SELECT trade_date, avg(r) AS b FROM limited WHERE r IS NOT NULL GROUP BY 1", "limited")
query(
    "benchmark_returns",
    "index_code trade_date",
    "return",
    """SELECT index_code, trade_date, "close" / lag("close") OVER (PARTITION BY index_code ORDER BY trade_date) - 1 AS "return"
       FROM (SELECT industry AS index_code, trade_date, avg("close") AS "close" FROM panel GROUP BY 1, 2)""",
    ("panel",),
)(lambda s, f: Po.benchmark_returns(panel(s, f).groupBy(F.col("industry").alias("index_code"), "trade_date").agg(F.avg("close").alias("close"))))
_S = "PARTITION BY strategy_id ORDER BY trade_date"
_C = f"product(1 + r) OVER ({_S} ROWS UNBOUNDED PRECEDING) - 1"
view(
    "dd",
    f"""SELECT *, (c - peak) / (1 + peak) AS drawdown FROM (SELECT *, max(c) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS peak FROM (
        SELECT *, {_C} AS c, row_number() OVER ({_S}) AS i FROM bt))""",
    "bt",
)
query(
    "simple_returns",
    "strategy_id trade_date",
    "return",
    """SELECT strategy_id, trade_date, r AS "return" FROM (SELECT industry AS strategy_id, trade_date, c / lag(c) OVER (PARTITION BY industry ORDER BY trade_date) - 1 AS r
       FROM (SELECT industry, trade_date, avg("close") AS c FROM panel GROUP BY 1, 2)) WHERE r IS NOT NULL""",
    ("panel",),
)(lambda s, f: V.simple_returns(panel(s, f).groupBy(F.col("industry").alias("strategy_id"), "trade_date").agg(F.avg("close").alias("close"))))
query("strategy_drawdowns", "strategy_id trade_date", "cumulative_return running_max drawdown", "SELECT *, c AS cumulative_return, peak AS running_max FROM dd", ("dd",))(
    lambda s, f: V.drawdowns(strategy_returns(s, f))
)
view(
    "maxdd",
    """SELECT strategy_id, min(drawdown) AS max_drawdown, arg_min(trade_date, drawdown) AS max_drawdown_end, arg_min(i, drawdown) AS e FROM dd GROUP BY 1""",
    "dd",
)
query(
    "max_drawdown",
    "strategy_id max_drawdown_duration max_drawdown_end",
    "max_drawdown",
    """SELECT m.strategy_id, max_drawdown, max_drawdown_end, m.e - arg_max(d.i, d.c) + 1 AS max_drawdown_duration FROM maxdd m JOIN dd d ON d.strategy_id = m.strategy_id AND d.i <= m.e GROUP BY 1, 2, 3, m.e""",
    ("maxdd",),
)(lambda s, f: V.max_drawdown(strategy_returns(s, f)))
_R = "count(*)"
view(
    "perf",
    """SELECT strategy_id, count(*) AS n, product(1 + r) - 1 AS total_return, pow(product(1 + r), 252.0 / count(*)) - 1 AS annualized_return,
              stddev_samp(r) * sqrt(252) AS annualized_volatility, stddev_samp(r) FILTER (r < 0) * sqrt(252) AS down, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win_rate,
              avg(r) FILTER (r > 0) / abs(avg(r) FILTER (r < 0)) AS profit_loss_ratio, skewness(r) AS skewness, kurtosis(r) AS kurtosis, max(r) AS best_day, min(r) AS worst_day
       FROM bt GROUP BY 1""",
    "bt",
)
_PERF = """SELECT *, (annualized_return - 0.03) / annualized_volatility AS sharpe_ratio, (annualized_return - 0.03) / down AS sortino_ratio,
                  annualized_return / abs(max_drawdown) AS calmar_ratio FROM perf JOIN maxdd USING (strategy_id)"""
query(
    "strategy_performance",
    "strategy_id n",
    "total_return annualized_return annualized_volatility sharpe_ratio sortino_ratio calmar_ratio max_drawdown win_rate profit_loss_ratio skewness kurtosis best_day worst_day",
    _PERF,
    ("perf", "maxdd"),
)(lambda s, f: V.performance(strategy_returns(s, f)))
query(
    "tail_risk",
    "strategy_id",
    "var cvar",
    "SELECT strategy_id, max(v) AS var, avg(r) FILTER (r <= v) AS cvar FROM (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY strategy_id) AS v FROM bt) GROUP BY 1",
    ("bt",),
)(lambda s, f: V.tail_risk(strategy_returns(s, f)))
query(
    "against_benchmark",
    "strategy_id",
    "beta alpha tracking_error information_ratio",
    """SELECT strategy_id, beta, pr - (0.03 + beta * (pb - 0.03)) AS alpha, te AS tracking_error, m / te * sqrt(252) AS information_ratio FROM (
         SELECT strategy_id, covar_samp(r, b) / var_samp(b) AS beta, pow(product(1 + r), 252.0 / count(*)) - 1 AS pr, pow(product(1 + b), 252.0 / count(*)) - 1 AS pb,
                avg(r - b) AS m, stddev_samp(r - b) AS te FROM bt JOIN idx USING (trade_date) GROUP BY 1)""",
    ("bt", "idx"),
)(lambda s, f: V.against_benchmark(strategy_returns(s, f), index_returns(s, f), annualize=True))
query(
    "strategy_evaluation",
    "strategy_id n",
    "total_return sharpe_ratio max_drawdown var cvar beta information_ratio",
    f"""SELECT * FROM ({_PERF}) JOIN (SELECT strategy_id, max(v) AS var, avg(r) FILTER (r <= v) AS cvar FROM (
          SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY strategy_id) AS v FROM bt) GROUP BY 1) USING (strategy_id)
        JOIN (SELECT strategy_id, covar_samp(r, b) / var_samp(b) AS beta, avg(r - b) / stddev_samp(r - b) AS information_ratio FROM bt JOIN idx USING (trade_date) GROUP BY 1) USING (strategy_id)""",
    ("perf", "maxdd", "idx"),
)(lambda s, f: V.evaluate(strategy_returns(s, f), index_returns(s, f)))
_f60 = f"({_S} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
query(
    "rolling_sharpe",
    "strategy_id trade_date",
    "rolling_sharpe",
    f"""SELECT strategy_id, trade_date, CASE WHEN count(*) OVER {_f60} = 60 THEN CASE WHEN stddev_samp(r) OVER {_f60} > 0 THEN
          (pow(product(1 + r) OVER {_f60}, 252.0 / 60) - 1 - 0.03) / (stddev_samp(r) OVER {_f60} * sqrt(252)) ELSE 0 END END AS rolling_sharpe FROM bt""",
    ("bt",),
)(lambda s, f: V.rolling_sharpe(strategy_returns(s, f)))
view("monthly", "SELECT strategy_id, year(trade_date) AS y, month(trade_date) AS m, product(1 + r) - 1 AS x FROM bt GROUP BY 1, 2, 3", "bt")
query(
    "monthly_returns",
    "strategy_id year month",
    "monthly_return",
    "SELECT strategy_id, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, x AS monthly_return FROM monthly",
    ("monthly",),
)(lambda s, f: V.monthly_returns(strategy_returns(s, f)))
query(
    "monthly_return_table",
    "strategy_id month year",
    "monthly_return",
    """SELECT strategy_id, CAST(m AS INTEGER) AS month, year, max(x) FILTER (y = year) AS monthly_return
       FROM monthly, (SELECT DISTINCT CAST(y AS INTEGER) AS year FROM monthly) GROUP BY 1, 2, 3""",
    ("monthly",),
)(lambda s, f: cells(V.monthly_table(strategy_returns(s, f)), ["strategy_id", "month"], "year", "monthly_return"))


def trade_log(spark, folder):
    """Daily buys and sells: accepted order lines as buys, returned ones as sells, the line status as strategy."""
    li = table(spark, folder, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    return li.groupBy(
        F.col("l_linestatus").alias("strategy_id"),
        F.col("l_suppkey").alias("ts_code"),
        F.to_date("l_shipdate").alias("trade_date"),
        F.when(F.col("l_returnflag") == "A", "buy").otherwise("sell").alias("action"),
    ).agg(
        F.sum("l_extendedprice").alias("amount"),
        (F.sum("l_extendedprice") * 0.001).alias("commission"),
        F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("price"),
    )


view(
    "tlog",
    """SELECT l_linestatus AS strategy_id, l_suppkey AS ts_code, CAST(l_shipdate AS DATE) AS trade_date, CASE WHEN l_returnflag = 'A' THEN 'buy' ELSE 'sell' END AS action,
              sum(l_extendedprice) AS amount, sum(l_extendedprice) * 0.001 AS commission, sum(l_extendedprice) / sum(l_quantity) AS price
       FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2, 3, 4""",
)
view("tfirst", "SELECT strategy_id, ts_code, min(trade_date) AS bd, arg_min(amount, trade_date) AS ba, arg_min(commission, trade_date) AS bc FROM tlog WHERE action = 'buy' GROUP BY 1, 2", "tlog")
query(
    "trade_statistics",
    "strategy_id total_trades",
    "win_rate avg_holding_days turnover_rate",
    """SELECT strategy_id, count(*) AS total_trades, count(*) FILTER (action = 'sell' AND bd < trade_date AND amount - ba - commission - bc > 0) / count(*) FILTER (action = 'sell') AS win_rate,
              sum(trade_date - bd) FILTER (action = 'sell' AND bd < trade_date) / count(*) FILTER (action = 'sell') AS avg_holding_days,
              sum(amount) FILTER (action = 'buy') / 1e7 / (2499 / 252.0) AS turnover_rate
       FROM tlog LEFT JOIN tfirst USING (strategy_id, ts_code) GROUP BY 1""",
    ("tlog", "tfirst"),
    digits=5,
)(lambda s, f: V.trade_statistics(trade_log(s, f), 1e7, 2499))
query(
    "first_earlier_buy",
    "strategy_id ts_code sell_date buy_date",
    {"sell_price": 8, "buy_price": 8},
    """SELECT s.strategy_id, s.ts_code, s.trade_date AS sell_date, s.price AS sell_price, b.trade_date AS buy_date, b.price AS buy_price FROM tlog s JOIN tlog b
         ON b.ts_code = s.ts_code AND b.strategy_id = s.strategy_id AND b.action = 'buy' AND b.trade_date < s.trade_date
       WHERE s.action = 'sell' QUALIFY row_number() OVER (PARTITION BY s.strategy_id, s.ts_code, s.trade_date ORDER BY b.trade_date) = 1""",
    ("tlog",),
)(lambda s, f: J.first_earlier_buy(trade_log(s, f)))
query(
    "strategy_comparison",
    "strategy_id metric place",
    "value",
    " UNION ALL ".join(
        f"SELECT strategy_id, '{m}' AS metric, {m} AS value, row_number() OVER (ORDER BY {m} DESC NULLS LAST, strategy_id) AS place FROM perf" for m in ("total_return", "annualized_volatility", "win_rate")
    ),
    ("perf",),
)(lambda s, f: V.compare(V.performance(strategy_returns(s, f)), ["total_return", "annualized_volatility", "win_rate"]))
query(
    "strategy_result_list",
    "strategy_id",
    "total_return",
    "SELECT strategy_id, total_return FROM perf WHERE strategy_id IN ('mom', 'rng')",
    ("perf",),
)(lambda s, f: V.result_list(V.performance(strategy_returns(s, f)), ["mom", "rng"]))
query(
    "point_to_point_return",
    "ts_code",
    "start_price end_price period_return period_return_pct",
    """SELECT ts_code, a AS start_price, b AS end_price, CASE WHEN a > 0 THEN (b - a) / a END AS period_return, CASE WHEN a > 0 THEN (b - a) / a * 100 END AS period_return_pct FROM (
         SELECT ts_code, max("close") FILTER (trade_date = DATE '1997-03-03') AS a, max("close") FILTER (trade_date = DATE '1999-03-03') AS b
         FROM bars WHERE trade_date IN (DATE '1997-03-03', DATE '1999-03-03') GROUP BY 1)""",
)(lambda s, f: V.point_to_point(bars(s, f), "1997-03-03", "1999-03-03"))


def investors(spark, folder):
    """Customers as investors: balance and nation give tolerance, horizon and experience."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        (F.col("c_nationkey") % 10 + 1).alias("risk_tolerance"),
        (F.col("c_nationkey") * 2 + 1).alias("time_horizon"),
        F.when(F.col("c_acctbal") < 2000, "beginner").when(F.col("c_acctbal") < 6000, "intermediate").otherwise("advanced").alias("experience"),
        F.when(F.col("c_acctbal") > 0, F.lit(0.4)).otherwise(0.1).alias("loss_tolerance"),
    )


def templates(spark, folder):
    """One strategy template per region."""
    k = F.col("r_regionkey")
    return table(spark, folder, "region").select(
        F.col("r_name").alias("template_id"),
        (k + 1).alias("risk_level"),
        F.when(k < 2, "conservative").when(k < 4, "balanced").otherwise("aggressive").alias("category"),
        ((k + 1) * 0.08).alias("expected_volatility"),
        (k * 0.02 + 0.05).alias("position_size"),
        (k * 5 + 5).alias("max_positions"),
        F.when(k < 2, "daily").when(k < 4, "weekly").otherwise("monthly").alias("rebalance_frequency"),
        (k * 0.05).alias("stop_loss"),
    )


view(
    "investors",
    """SELECT c_custkey AS user_id, c_nationkey % 10 + 1 AS risk_tolerance, c_nationkey * 2 + 1 AS time_horizon,
              CASE WHEN c_acctbal < 2000 THEN 1 WHEN c_acctbal < 6000 THEN 3 ELSE 5 END AS ex, CASE WHEN c_acctbal > 0 THEN 0.4 ELSE 0.1 END AS loss_tolerance FROM customer""",
)
view(
    "templates",
    """SELECT r_name AS template_id, r_regionkey + 1 AS risk_level, CASE WHEN r_regionkey < 2 THEN 'conservative' WHEN r_regionkey < 4 THEN 'balanced' ELSE 'aggressive' END AS category,
              (r_regionkey + 1) * 0.08 AS vol, r_regionkey * 0.02 + 0.05 AS ps, r_regionkey * 5 + 5 AS mp,
              CASE WHEN r_regionkey < 2 THEN 'daily' WHEN r_regionkey < 4 THEN 'weekly' ELSE 'monthly' END AS rf, r_regionkey * 0.05 AS sl FROM region""",
)
query(
    "template_recommendation",
    "user_id template_id rank risk_class max_positions rebalance_frequency",
    "match_score position_size stop_loss",
    """SELECT user_id, template_id, rank, match_score, CASE WHEN risk_tolerance <= 3 THEN 'conservative' WHEN risk_tolerance <= 7 THEN 'balanced' ELSE 'aggressive' END AS risk_class,
              CAST(CASE WHEN risk_tolerance <= 3 THEN least(mp + 3, 20) WHEN risk_tolerance >= 8 THEN greatest(mp - 2, 5) ELSE mp END AS INTEGER) AS max_positions,
              CASE WHEN time_horizon >= 24 AND rf = 'daily' THEN 'weekly' WHEN time_horizon >= 24 AND rf = 'weekly' THEN 'monthly' ELSE rf END AS rebalance_frequency,
              CASE WHEN risk_tolerance <= 3 THEN ps * 0.8 WHEN risk_tolerance >= 8 THEN ps * 1.2 ELSE ps END AS position_size,
              CASE WHEN sl > 0 THEN least(sl, loss_tolerance) ELSE sl END AS stop_loss FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(match_score, 9) DESC, template_id) AS rank FROM (
           SELECT *, greatest(0, least(1, (1 - abs(risk_tolerance - risk_level * 2) / 10.0) * 0.4 + (1 - abs(ex - risk_level) / 5.0) * 0.2
             + CASE WHEN (category = 'conservative' AND time_horizon >= 12) OR (category = 'balanced' AND time_horizon BETWEEN 6 AND 36) OR (category = 'aggressive' AND time_horizon <= 24) THEN 1.0 ELSE 0.5 END * 0.2
             + CASE WHEN vol * 2 <= loss_tolerance THEN 1.0 ELSE 0.5 END * 0.2)) AS match_score FROM investors, templates) WHERE round(match_score, 9) > 0.5) WHERE rank <= 3""",
    ("investors", "templates"),
)(lambda s, f: Po.recommend_templates(investors(s, f), templates(s, f)))
query(
    "prediction_enrichment",
    "ts_code trade_date name industry rank_overall label",
    {"score": 8},
    """SELECT p.ts_code, p.trade_date, b.name, b.industry, s.rank_overall, s.score, (p.mom > 0)::INT AS label FROM panel p LEFT JOIN placed s ON s.ts_code = p.ts_code AND s.trade_date = p.trade_date LEFT JOIN basic b ON b.ts_code = p.ts_code
       WHERE p.mom IS NOT NULL""",
    ("panel", "placed", "basic"),
)(
    lambda s, f: panel(s, f).where(F.col("mom").isNotNull()).select("ts_code", "trade_date", F.when(F.col("mom") > 0, 1).otherwise(0).alias("label"))
    .join(ranked(s, f).select("ts_code", "trade_date", "score", "rank_overall"), ["ts_code", "trade_date"], "left")
    .join(stock_basic(s, f).select("ts_code", "name", "industry"), "ts_code", "left")
)
