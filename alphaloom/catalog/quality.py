"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

import alphaloom.catalog.panel  # noqa: F401
from alphaloom.catalog.base import W, query, view
from alphaloom.catalog.monitoring import AS_OF, quality_metrics
from alphaloom.operators import quality as Q
from alphaloom.operators import technical as T
from alphaloom.sources.tables import bars, panel, statements, stock_basic

KEYS = "ts_code trade_date"
C = '"close"'


def dirty(spark, folder):
    """Bars with planted faults chosen by traded volume: gaps, broken highs, no volume, negatives."""
    v = F.col("vol")
    return bars(spark, folder).select(
        "ts_code",
        "trade_date",
        "open",
        F.when(v == 30, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(v == 25, F.lit(None)).when(v == 45, -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(v == 40, 0.0).when(v == 26, F.lit(None)).otherwise(v).alias("vol"),
        "amount",
        "pre_close",
    )


view(
    "dirty",
    """SELECT ts_code, trade_date, open, CASE WHEN vol = 30 THEN low - 1 ELSE high END AS high, low, CASE WHEN vol = 25 THEN NULL WHEN vol = 45 THEN -"close" ELSE "close" END AS "close",
              CASE WHEN vol = 40 THEN 0.0 WHEN vol = 26 THEN NULL ELSE vol END AS vol, amount, pre_close FROM bars""",
    "bars",
)
P = "OVER (PARTITION BY ts_code)"


def _fence(c, o=P):
    q1, q3 = f"quantile_cont({c}, 0.25) {o}", f"quantile_cont({c}, 0.75) {o}"
    return f"coalesce({c} < {q1} - 1.5 * ({q3} - {q1}) OR {c} > {q3} + 1.5 * ({q3} - {q1}), false)"


def _over(fn, source=dirty):
    return lambda s, f: fn(source(s, f))


query("outliers_iqr", KEYS + " is_outlier", "", f"SELECT ts_code, trade_date, {_fence(C)} AS is_outlier FROM dirty", ("dirty",))(_over(lambda d: Q.flag_outliers(d, "close")))
query(
    "outliers_zscore",
    KEYS + " is_outlier",
    "",
    f"SELECT ts_code, trade_date, coalesce(abs({C} - avg({C}) {P}) > 3 * stddev_samp({C}) {P}, false) AS is_outlier FROM dirty",
    ("dirty",),
)(_over(lambda d: Q.flag_outliers(d, "close", "zscore")))


def _fill(name, method, expr):
    query(f"fill_{name}", KEYS, {"close": 8}, f"SELECT ts_code, trade_date, {expr} AS {C} FROM dirty", ("dirty",))(_over(lambda d: Q.fill_missing(d, "close", method)))


_last = f"last_value({C} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)"
_next = f"first_value({C} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_fill("forward", "forward", _last)
_fill("backward", "backward", _next)
query("fill_mean", KEYS, {"close": 8}, f"SELECT ts_code, trade_date, coalesce({C}, avg({C}) {P}) AS {C} FROM dirty", ("dirty",))(_over(lambda d: Q.fill_missing(d, "close", "mean")))
_fill("median", "median", f"coalesce({C}, median({C}) {P})")
query(
    "fill_industry_mean",
    KEYS,
    {"close": 8},
    f"""SELECT ts_code, trade_date, coalesce({_last}, CASE WHEN industry IS NOT NULL THEN avg({C}) OVER (PARTITION BY industry) END, (SELECT avg({C}) FROM dirty)) AS {C}
        FROM dirty LEFT JOIN basic USING (ts_code)""",
    ("dirty", "basic"),
)(lambda s, f: Q.fill_missing(dirty(s, f).join(stock_basic(s, f).select("ts_code", "industry"), "ts_code", "left"), "close", "industry_mean"))

_neg = " + ".join(f"coalesce({c} < 0, false)::INT" for c in ("open", "high", "low", C))
_ohlc = f"coalesce(high < open OR high < {C} OR high < low OR low > open OR low > {C}, false)::INT"
_ext = f"coalesce(abs(({C} - pre_close) / nullif(pre_close, 0)) > 0.2, false)::INT"
_zero = "coalesce(vol = 0, false)::INT"
view("flags", f"SELECT *, {_neg} AS e1, {_ohlc} AS e2, {_ext} AS e3, {_zero} AS e4 FROM dirty", "dirty")
query(
    "price_errors",
    KEYS + " error hits",
    "",
    " UNION ALL ".join(f"SELECT ts_code, trade_date, '{n}' AS error, CAST(e{i} AS BIGINT) AS hits FROM flags WHERE e{i} > 0" for i, n in enumerate(Q.ERRORS, 1)),
    ("flags",),
)(_over(Q.price_errors))


def _clean_sql():
    cols = ["open", "high", "low", C, "pre_close"]
    filled = ", ".join(f"last_value({c} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS {c}" for c in cols)
    cut = ", ".join(f"CASE WHEN NOT {_fence(c)} THEN {c} END AS {c}" for c in cols)
    return f"""SELECT ts_code, trade_date, {filled}, vol, amount FROM (SELECT ts_code, trade_date, {cut}, vol, amount FROM (
               SELECT ts_code, trade_date, {filled}, coalesce(vol, median(vol) {P}) AS vol, coalesce(amount, median(amount) {P}) AS amount FROM dirty))"""


query("clean_prices", KEYS, {"open": 8, "high": 8, "low": 8, "close": 8, "pre_close": 8, "vol": 4, "amount": 4}, _clean_sql(), ("dirty",))(_over(Q.clean_prices))

_num = ["open", "high", "low", C, "vol", "amount", "pre_close"]
_all = ["ts_code", "trade_date"] + _num


def _score_sql(source):
    return f"""SELECT *, (completeness + consistency + accuracy + timeliness) / 4 AS overall_score FROM (
        SELECT ts_code, count(*) AS data_count, greatest(0, 1 - sum({' + '.join(f'({c} IS NULL)::INT' for c in _all)}) / (count(*) * 9.0)) AS completeness,
               greatest(0, 1 - sum(e1 + e2 + e3 + e4) / count(*)) AS consistency, greatest(0, 1 - sum(outs) / (count(*) * 7.0)) AS accuracy,
               coalesce(count(*) FILTER (gap BETWEEN 1 AND 3) / nullif(count(gap), 0), 1.0) AS timeliness FROM (
          SELECT *, trade_date - lag(trade_date) OVER ({W}) AS gap, {' + '.join(f'{_fence(c)}::INT' for c in _num)} AS outs FROM {source}) GROUP BY 1)"""


query(
    "quality_score",
    "ts_code data_count",
    "completeness consistency accuracy timeliness overall_score",
    _score_sql("flags"),
    ("flags",),
)(_over(Q.quality_score))
query(
    "quality_check_recent",
    "ts_code data_count status",
    "overall_score",
    f"""SELECT *, CASE WHEN completeness >= 0.95 AND consistency >= 0.98 AND accuracy >= 0.9 AND timeliness >= 0.85 AND overall_score >= 0.9 THEN 'PASS' ELSE 'ALERT' END AS status
        FROM ({_score_sql("(SELECT * FROM flags WHERE trade_date >= DATE '2000-06-30' - 365 AND trade_date <= DATE '2000-06-30')")})""",
    ("flags",),
)(_over(lambda d: Q.check_recent(d, "2000-06-30", 365)))
query("quality_sample", "ts_code", "", "SELECT DISTINCT ON (h, ts_code) ts_code FROM (SELECT ts_code, md5('42|' || ts_code) AS h FROM dirty) ORDER BY h, ts_code LIMIT 20", ("dirty",))(_over(lambda d: Q.sample_codes(d, 20)))

RULES_AS_OF = "2001-11-10"


def rule_results(spark, folder):
    rules = Q.default_rules() + [
        Q.Rule("amount_outlier_check", "outlier", "accuracy", "amount", None, "warning", True, {"method": "iqr"}),
        Q.Rule("volume_nulls", "null", "completeness", "vol", 0.01),
        Q.Rule("switched_off", "null", "completeness", "open", 0.01, enabled=False),
    ]
    return Q.run_rules(dirty(spark, folder), rules, RULES_AS_OF)


view(
    "rules",
    f"""SELECT rule_id, dimension, check_type, value, passed, greatest(0, least(100, score)) AS score FROM (
        SELECT 'stock_data_completeness' AS rule_id, 'completeness' AS dimension, 'null' AS check_type, v AS value, v <= 0.05 AS passed, 100 * (1 - v / 0.05) AS score
          FROM (SELECT avg(({C} IS NULL)::INT) AS v FROM dirty)
        UNION ALL SELECT 'volume_nulls', 'completeness', 'null', v, v <= 0.01, 100 * (1 - v / 0.01) FROM (SELECT avg((vol IS NULL)::INT) AS v FROM dirty)
        UNION ALL SELECT 'price_range_check', 'accuracy', 'range', v, v >= 0.95, 100 * v FROM (SELECT count(*) FILTER ({C} >= 0.01 AND {C} <= 10000) / count({C}) AS v FROM dirty)
        UNION ALL SELECT 'volume_outlier_check', 'accuracy', 'outlier', v, v <= 0.05, 100 * (1 - v / 0.05) FROM (
          SELECT count(*) FILTER (abs(vol - (SELECT avg(vol) FROM dirty)) > 3 * (SELECT stddev_pop(vol) FROM dirty)) / count(vol) AS v FROM dirty)
        UNION ALL SELECT 'amount_outlier_check', 'accuracy', 'outlier', v, v <= 0.05, 100 * (1 - v / 0.05) FROM (
          SELECT count(*) FILTER (amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1)) / count(amount) AS v FROM dirty,
            (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM dirty))
        UNION ALL SELECT 'data_freshness_check', 'timeliness', 'freshness', v, v <= 24, 100 * (1 - v / 48) FROM (SELECT (DATE '{RULES_AS_OF}' - max(trade_date)) * 24.0 AS v FROM dirty)
        UNION ALL SELECT 'duplicate_check', 'uniqueness', 'duplicate', v, v <= 0.01, 100 * (1 - v / 0.01) FROM (SELECT (count(*) - count(DISTINCT (ts_code, trade_date))) / count(*) AS v FROM dirty))""",
    "dirty",
)
query("quality_rules", "rule_id dimension check_type passed", "value score", "SELECT * FROM rules", ("rules",))(rule_results)
_sev = "CASE WHEN score < 50 THEN 'critical' WHEN score < 80 THEN 'error' ELSE 'warning' END"
query(
    "quality_report",
    "total_checks passed_checks critical_issues error_issues warning_issues",
    "overall_score",
    f"""SELECT avg(s) AS overall_score, CAST(sum(n) AS BIGINT) AS total_checks, CAST(sum(ok) AS BIGINT) AS passed_checks, CAST(sum(c) AS BIGINT) AS critical_issues,
               CAST(sum(e) AS BIGINT) AS error_issues, CAST(sum(w) AS BIGINT) AS warning_issues FROM (
          SELECT dimension, avg(score) AS s, count(*) AS n, count(*) FILTER (passed) AS ok, count(*) FILTER (NOT passed AND {_sev} = 'critical') AS c,
                 count(*) FILTER (NOT passed AND {_sev} = 'error') AS e, count(*) FILTER (NOT passed AND {_sev} = 'warning') AS w FROM rules GROUP BY 1)""",
    ("rules",),
)(lambda s, f: Q.rule_report(rule_results(s, f)))
query(
    "quality_alerts",
    "rule_id dimension severity status",
    "score",
    f"SELECT rule_id, dimension, {_sev} AS severity, 'active' AS status, score FROM rules WHERE NOT passed",
    ("rules",),
)(lambda s, f: Q.quality_alerts(rule_results(s, f)))
query(
    "quality_history",
    "table_name data_type report_date",
    "overall_score",
    f"SELECT data_source AS table_name, data_type, report_date, overall_score FROM qmetrics WHERE report_date >= DATE '{AS_OF}' - 7 AND data_source = 'click'",
    ("qmetrics",),
)(lambda s, f: Q.quality_history(quality_metrics(s, f).withColumnRenamed("data_source", "table_name"), AS_OF, "click"))

for _c in ("vol", "amount"):
    view(f"mad_{_c}", f"SELECT ts_code, trade_date, abs({_c} - med) / nullif(median(abs({_c} - med)) OVER (), 0) AS z FROM (SELECT *, median({_c}) OVER () AS med FROM dirty)", "dirty")
_anom = "SELECT ts_code, trade_date, greatest(coalesce(a.z, 0), coalesce(b.z, 0)) AS anomaly_score FROM mad_vol a JOIN mad_amount b USING (ts_code, trade_date)"
query("robust_anomalies", KEYS + " is_anomaly", "anomaly_score", f"SELECT *, anomaly_score > 6 AS is_anomaly FROM ({_anom})", ("mad_vol", "mad_amount"))(
    _over(lambda d: Q.robust_anomalies(d, ["vol", "amount"]))
)
query(
    "validate_batch",
    "rows dates_unique",
    "null_ratio anomaly_ratio overall_score",
    f"""SELECT *, (100 - null_ratio * 100 + 100 - anomaly_ratio * 100 + 100) / 3 AS overall_score FROM (
          SELECT count(*) AS rows, count(*) = count(DISTINCT (ts_code, trade_date)) AS dates_unique, sum({' + '.join(f'({c} IS NULL)::INT' for c in _all)}) / (count(*) * 9.0) AS null_ratio,
                 (SELECT avg((anomaly_score > 6)::INT) FROM ({_anom})) AS anomaly_ratio FROM dirty)""",
    ("dirty", "mad_vol", "mad_amount"),
)(_over(lambda d: Q.validate_batch(d, ["vol", "amount"])))

query(
    "validate_frame",
    "row_count duplicate_rows null_close null_vol null_pre_close missing_tier",
    "missing_ratio",
    f"""SELECT count(*) AS row_count, 0::BIGINT AS duplicate_rows, count(*) - count({C}) AS null_close, count(*) - count(vol) AS null_vol, count(*) - count(pre_close) AS null_pre_close,
               sum({' + '.join(f'({c} IS NULL)::INT' for c in _all)}) / (count(*) * 9.0) AS missing_ratio, 'ok' AS missing_tier FROM dirty""",
    ("dirty",),
)(_over(Q.validate_frame))
query(
    "validate_bars",
    "ts_code negative_close extreme_close extreme_open high_errors low_errors negative_vol duplicate_dates first_date last_date",
    "",
    f"""SELECT ts_code, count(*) FILTER ({C} < 0) AS negative_close, count(*) FILTER (abs(mc) > 0.5) AS extreme_close, count(*) FILTER (abs(mo) > 0.5) AS extreme_open,
               count(*) FILTER (high < open OR high < {C} OR high < low) AS high_errors, count(*) FILTER (low > open OR low > {C} OR low > high) AS low_errors,
               count(*) FILTER (vol < 0) AS negative_vol, 0::BIGINT AS duplicate_dates, min(trade_date) AS first_date, max(trade_date) AS last_date FROM (
          SELECT *, {C} / nullif(lag({C}) OVER ({W}), 0) - 1 AS mc, open / nullif(lag(open) OVER ({W}), 0) - 1 AS mo FROM dirty) GROUP BY 1""",
    ("dirty",),
)(_over(Q.validate_bars))
_f3 = " UNION ALL ".join(f"SELECT '{c}' AS factor_name, {c} AS x FROM panel WHERE {c} IS NOT NULL" for c in ("mom", "volr", "rng"))
query(
    "validate_factors",
    "factor_name n infinite outliers many_outliers",
    {"mean": 5, "std": 5, "min": 5, "max": 5},
    f"""SELECT factor_name, count(*) AS n, 0::BIGINT AS infinite, count(*) FILTER (o) AS outliers, avg(o::INT) > 0.1 AS many_outliers, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max
        FROM (SELECT *, {_fence('x', 'OVER (PARTITION BY factor_name)')} AS o FROM ({_f3})) GROUP BY 1""",
    ("panel",),
)(_over(lambda d: Q.validate_factors(d, ["mom", "volr", "rng"]), panel))


def _ranges_sql(source, ranges, names):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, "
        + (f"count(*) FILTER ({c} < {ranges[c][0]})" if ranges[c][0] is not None else "0::BIGINT")
        + " AS below, "
        + (f"count(*) FILTER ({c} > {ranges[c][1]})" if ranges[c][1] is not None else "0::BIGINT")
        + f" AS above FROM {source}"
        for c in names
    )


_fin = "(SELECT net_profit / total_hldr_eqy_exc_min_int AS roe, net_profit / total_assets AS roa, total_cur_assets / nullif(total_cur_liab, 0) AS current_ratio FROM statements)"
query("financial_range_violations", "column n below above", "", _ranges_sql(_fin, Q.FINANCIAL_RANGES, ["roe", "roa", "current_ratio"]), ("statements",))(
    lambda s, f: Q.range_violations(
        statements(s, f).select(
            (F.col("net_profit") / F.col("total_hldr_eqy_exc_min_int")).alias("roe"),
            (F.col("net_profit") / F.col("total_assets")).alias("roa"),
            F.try_divide("total_cur_assets", "total_cur_liab").alias("current_ratio"),
        ),
        Q.FINANCIAL_RANGES,
    )
)
query(
    "factor_range_violations",
    "column n below above",
    "",
    _ranges_sql("(SELECT volr - 0.5 AS volume_ratio, mom / 100 AS revenue_growth FROM panel)", Q.FACTOR_RANGES, ["volume_ratio", "revenue_growth"]),
    ("panel",),
)(lambda s, f: Q.range_violations(panel(s, f).select((F.col("volr") - 0.5).alias("volume_ratio"), (F.col("mom") / 100).alias("revenue_growth")), Q.FACTOR_RANGES))
query(
    "factor_concentration",
    "factor_name n distinct_values extreme few_distinct many_extreme",
    "",
    f"""SELECT factor_name, count(*) AS n, count(DISTINCT x) AS distinct_values, count(*) FILTER (abs(x - m) > 3 * s) AS extreme, count(DISTINCT x) / count(*) < 0.1 AS few_distinct,
               count(*) FILTER (abs(x - m) > 3 * s) > count(*) * 0.05 AS many_extreme
        FROM (SELECT *, avg(x) OVER (PARTITION BY factor_name) AS m, stddev_samp(x) OVER (PARTITION BY factor_name) AS s FROM ({_f3})) GROUP BY 1""",
    ("panel",),
)(_over(lambda d: Q.factor_concentration(d, ["mom", "volr", "rng"]), panel))
query(
    "table_quality_check",
    "trade_date total_records null_records duplicate_records status",
    "quality_score",
    f"""SELECT *, CASE WHEN quality_score >= 95 THEN 'PASS' WHEN quality_score >= 80 THEN 'WARN' ELSE 'FAIL' END AS status FROM (
          SELECT trade_date, count(*) AS total_records, count(*) FILTER ({C} IS NULL OR vol IS NULL) AS null_records, 0::BIGINT AS duplicate_records,
                 100 - count(*) FILTER ({C} IS NULL OR vol IS NULL) / count(*) * 50 AS quality_score FROM dirty GROUP BY 1)""",
    ("dirty",),
)(_over(lambda d: Q.table_check(d, ["ts_code", "trade_date"], ["close", "vol"])))


def rsi_versions(spark, folder):
    """RSI before and after a recalculation that changes the window from 14 to 13."""
    b = bars(spark, folder)

    def one(n):
        return T.rsi(b, n, out="factor_value").select(F.lit("rsi_14").alias("factor_name"), "ts_code", "trade_date", "factor_value")

    return one(14), one(13)


def _rsi(n):
    f = f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    u, d = f"avg(up) OVER {f}", f"avg(dn) OVER {f}"
    return f"CASE WHEN count(*) OVER {f} = {n} THEN CASE WHEN {d} = 0 THEN CASE WHEN {u} > 0 THEN 100 END ELSE 100 - 100 / (1 + {u} / ({d})) END END"


view(
    "recalc",
    f"""SELECT *, abs((new_value - old_value) / nullif(old_value, 0)) AS pct, coalesce(abs((new_value - old_value) / nullif(old_value, 0)) > 0.05, false) AS sig FROM (
          SELECT 'rsi_14' AS factor_name, ts_code, trade_date, {_rsi(14)} AS old_value, {_rsi(13)} AS new_value FROM (
            SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM (SELECT *, coalesce({C} - pre_close, 0) AS d FROM bars)))""",
    "bars",
)
query(
    "compare_recalculation",
    "factor_name ts_code trade_date is_significant",
    "old_value new_value difference pct_change",
    "SELECT *, new_value - old_value AS difference, pct AS pct_change, sig AS is_significant FROM recalc",
    ("recalc",),
)(lambda s, f: Q.compare_recalculation(*rsi_versions(s, f)))


def recalc_status(spark, folder):
    old, new = rsi_versions(spark, folder)
    return Q.recalculation_status(Q.compare_recalculation(old, new), new)


view(
    "rstatus",
    """SELECT factor_name, ts_code, total_records, null_count, q AS quality_score, ratio AS significant_ratio, CASE WHEN q < 60 THEN 'FAILED' WHEN ratio > 0.1 THEN 'WARNING' ELSE 'PASSED' END AS validation_status FROM (
         SELECT factor_name, ts_code, count(*) AS total_records, count(*) - count(new_value) AS null_count, avg(sig::INT) AS ratio,
                100 - CASE WHEN (count(*) - count(new_value)) / count(*) * 100 > 5 THEN least(50, (count(*) - count(new_value)) / count(*) * 100) ELSE 0 END AS q FROM recalc GROUP BY 1, 2)""",
    "recalc",
)
query("recalculation_status", "factor_name ts_code total_records null_count validation_status", "quality_score significant_ratio", "SELECT * FROM rstatus", ("rstatus",))(recalc_status)
query(
    "recalculation_summary",
    "factor_name total_validations passed_count warning_count failed_count",
    "",
    """SELECT factor_name, count(*) AS total_validations, count(*) FILTER (validation_status = 'PASSED') AS passed_count, count(*) FILTER (validation_status = 'WARNING') AS warning_count,
              count(*) FILTER (validation_status = 'FAILED') AS failed_count FROM rstatus GROUP BY 1""",
    ("rstatus",),
)(lambda s, f: Q.recalculation_summary(recalc_status(s, f)))
query(
    "factor_version_quality",
    "factor_name version_id total_records",
    "completeness_score accuracy_score uniqueness_score overall_score",
    f"""SELECT *, (completeness_score + accuracy_score + uniqueness_score + 300) / 6 AS overall_score FROM (
          SELECT factor_name, version_id, count(*) AS total_records, count(v) / count(*) * 100 AS completeness_score, count(*) FILTER (v >= m - 3 * s AND v <= m + 3 * s) / count(v) * 100 AS accuracy_score,
                 count(DISTINCT (ts_code, trade_date)) / count(*) * 100 AS uniqueness_score FROM (
            SELECT *, avg(v) OVER (PARTITION BY factor_name, version_id) AS m, stddev_samp(v) OVER (PARTITION BY factor_name, version_id) AS s FROM (
              SELECT 'mom' AS factor_name, 'v1' AS version_id, ts_code, trade_date, mom AS v FROM panel UNION ALL SELECT 'rng', 'v1', ts_code, trade_date, rng FROM panel)) GROUP BY 1, 2)""",
    ("panel",),
)(
    lambda s, f: Q.version_quality(
        panel(s, f).unpivot(["ts_code", "trade_date"], ["mom", "rng"], "factor_name", "factor_value").withColumn("version_id", F.lit("v1"))
    )
)
query(
    "quality_trend",
    "data_source data_type report_date",
    "overall_score prev_score score_change",
    """SELECT *, overall_score - prev_score AS score_change FROM (SELECT *, lag(overall_score) OVER (PARTITION BY data_source, data_type ORDER BY report_date) AS prev_score FROM qmetrics)""",
    ("qmetrics",),
)(lambda s, f: Q.quality_trend(quality_metrics(s, f)))
