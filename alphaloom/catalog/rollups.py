"""Rollup and view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

import alphaloom.catalog.panel  # noqa: F401
from alphaloom.catalog import monitoring as M
from alphaloom.catalog.base import cells, query, view
from alphaloom.catalog.quality import dirty
from alphaloom.catalog.selection import ranked
from alphaloom.operators import joins as J
from alphaloom.operators import quality as Q
from alphaloom.operators import rollups as R
from alphaloom.sources.tables import bars, calendar, daily_basic, panel, stock_basic, table

FACTORS = ["mom", "volr", "rng"]
AS_OF = M.AS_OF

query(
    "quality_summary",
    "data_source data_type report_count critical_count poor_count fair_count good_count excellent_count latest_report_date",
    "avg_score min_score max_score",
    f"""SELECT data_source, data_type, count(*) AS report_count, avg(overall_score) AS avg_score, min(overall_score) AS min_score, max(overall_score) AS max_score,
        {', '.join(f"count(*) FILTER (quality_level = '{v}') AS {v}_count" for v in ('critical', 'poor', 'fair', 'good', 'excellent'))}, max(report_date) AS latest_report_date
        FROM qmetrics WHERE report_date >= DATE '{AS_OF}' - 15 GROUP BY 1, 2""",
    ("qmetrics",),
)(lambda s, f: R.quality_summary(M.quality_metrics(s, f), AS_OF, 15))
query(
    "anomaly_summary",
    "data_source data_type anomaly_type anomaly_count fixed_count pending_count latest_anomaly_date",
    "avg_anomaly_score",
    f"""SELECT data_source, data_type, anomaly_type, count(*) AS anomaly_count, count(*) FILTER (status = 'fixed') AS fixed_count, count(*) FILTER (status = 'detected') AS pending_count,
               avg(anomaly_score) AS avg_anomaly_score, max(anomaly_date) AS latest_anomaly_date FROM anomalies WHERE anomaly_date >= DATE '{AS_OF}' - 15 GROUP BY 1, 2, 3""",
    ("anomalies",),
)(lambda s, f: R.anomaly_summary(M.anomalies(s, f), AS_OF, 15))
query(
    "null_duplicate_ratios",
    "trade_date total_records",
    {"null_percentage": 2, "duplicate_percentage": 2},
    """SELECT trade_date, count(*) AS total_records, round(count(*) FILTER ("close" IS NULL OR vol IS NULL) / count(*) * 100, 2) AS null_percentage, 0.0 AS duplicate_percentage FROM dirty GROUP BY 1""",
    ("dirty",),
)(lambda s, f: R.null_duplicate_ratios(Q.table_check(dirty(s, f), ["ts_code", "trade_date"], ["close", "vol"])))
query(
    "validity_overview",
    "data_source total_records valid_records invalid_records last_updated",
    {"valid_percentage": 2},
    """SELECT data_source, count(*) AS total_records, count(*) FILTER (status <> 'failed') AS valid_records, count(*) FILTER (status = 'failed') AS invalid_records,
              round(count(*) FILTER (status <> 'failed') * 100.0 / count(*), 2) AS valid_percentage, max(created_at) AS last_updated FROM tasks GROUP BY 1""",
    ("tasks",),
)(
    lambda s, f: R.validity_overview(
        M.tasks(s, f).select("data_source", (F.col("status") != "failed").alias("is_valid"), F.col("created_at").alias("last_updated")), "data_source"
    )
)
query(
    "test_summary",
    "test_session_id test_phase total_tests passed_tests failed_tests skipped_tests start_time end_time",
    {"avg_execution_time": 2},
    """SELECT CAST(created_at AS DATE) AS test_session_id, data_source AS test_phase, count(*) AS total_tests, count(*) FILTER (status = 'success') AS passed_tests,
              count(*) FILTER (status = 'failed') AS failed_tests, count(*) FILTER (status = 'pending') AS skipped_tests, round(avg(duration_seconds), 3) AS avg_execution_time,
              min(created_at) AS start_time, max(created_at) AS end_time FROM tasks GROUP BY 1, 2""",
    ("tasks",),
)(
    lambda s, f: R.test_summary(
        M.tasks(s, f).select(
            F.to_date("created_at").alias("test_session_id"),
            F.col("data_source").alias("test_phase"),
            F.when(F.col("status") == "success", "passed").when(F.col("status") == "pending", "skipped").otherwise(F.col("status")).alias("test_status"),
            F.col("duration_seconds").alias("execution_time"),
            "created_at",
        )
    )
)
query(
    "task_statistics",
    "data_source data_type status execution_date task_count tasks_with_retries",
    "avg_duration_seconds min_duration_seconds max_duration_seconds avg_retry_count",
    """SELECT data_source, data_type, status, CAST(created_at AS DATE) AS execution_date, count(*) AS task_count, avg(duration_seconds) AS avg_duration_seconds, min(duration_seconds) AS min_duration_seconds,
              max(duration_seconds) AS max_duration_seconds, avg(retry_count) AS avg_retry_count, count(*) FILTER (retry_count > 0) AS tasks_with_retries FROM tasks GROUP BY 1, 2, 3, 4""",
    ("tasks",),
    digits=5,
)(lambda s, f: R.task_statistics(M.tasks(s, f)))
query(
    "resource_usage",
    "usage_date usage_hour concurrent_tasks total_api_calls",
    "avg_cpu_usage peak_cpu_usage",
    """SELECT CAST(created_at AS DATE) AS usage_date, CAST(hour(created_at) AS INTEGER) AS usage_hour, count(DISTINCT user_id) AS concurrent_tasks, CAST(sum(retry_count) AS BIGINT) AS total_api_calls,
              avg(duration_seconds) AS avg_cpu_usage, max(duration_seconds) AS peak_cpu_usage FROM tasks GROUP BY 1, 2""",
    ("tasks",),
    digits=9,
)(
    lambda s, f: R.resource_usage(
        M.tasks(s, f).select(
            F.col("created_at").alias("allocation_time"), F.col("duration_seconds").alias("cpu"), F.col("retry_count").alias("api_calls"), F.col("user_id").alias("task_id")
        )
    )
)
query(
    "status_progress",
    "status count",
    "avg_duration percentage",
    "SELECT status, count(*) AS count, avg(duration_seconds) AS avg_duration, count(*) / (SELECT count(*) FROM tasks) * 100 AS percentage FROM tasks GROUP BY 1",
    ("tasks",),
)(lambda s, f: R.status_progress(M.tasks(s, f)))
query(
    "hourly_throughput",
    "total_tasks completed_tasks failed_tasks",
    "avg_duration",
    """SELECT count(*) AS total_tasks, count(*) FILTER (status = 'success') AS completed_tasks, count(*) FILTER (status = 'failed') AS failed_tasks, coalesce(avg(duration_seconds), 0) AS avg_duration
       FROM tasks WHERE created_at BETWEEN TIMESTAMP '2024-01-15 11:00:00' AND TIMESTAMP '2024-01-15 12:00:00'""",
    ("tasks",),
)(lambda s, f: R.hourly_throughput(M.tasks(s, f), "2024-01-15 12:00:00"))
query(
    "active_dashboard",
    "kind name n",
    "avg_progress",
    " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS name, count(*) AS n, avg(progress) AS avg_progress FROM tasks WHERE status IN ('running', 'pending') GROUP BY 2" for k in ("status", "data_source", "data_type")),
    ("tasks",),
)(lambda s, f: R.active_dashboard(M.tasks(s, f)))
query(
    "value_counts",
    "column value n",
    "",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM malerts GROUP BY 2" for c in ("severity", "alert_type", "status")),
    ("malerts",),
)(lambda s, f: R.value_counts(M.model_alerts(s, f), ["severity", "alert_type", "status"]))
view("flong", " UNION ALL ".join(f"SELECT ts_code, trade_date, '{c}' AS factor_name, {c} AS factor_value FROM panel" for c in FACTORS), "panel")


def long(spark, folder):
    return panel(spark, folder).unpivot(["ts_code", "trade_date"], FACTORS, "factor_name", "factor_value")


query("pivot_factors", "ts_code trade_date", "mom volr rng", "SELECT ts_code, trade_date, mom, volr, rng FROM panel", ("panel",), digits=9)(
    lambda s, f: R.pivot_first(long(s, f), ["ts_code", "trade_date"], FACTORS)
)
query("unpivot_factors", "ts_code trade_date factor_name", "factor_value", "SELECT * FROM flong WHERE factor_value IS NOT NULL", ("flong",), digits=9)(
    lambda s, f: long(s, f).dropna(subset=["factor_value"])
)
query(
    "pivot_mean_by_year",
    "factor_name year",
    "mean",
    """SELECT factor_name, year, avg(factor_value) FILTER (year(trade_date) = year) AS mean
       FROM flong, (SELECT DISTINCT CAST(year(trade_date) AS INTEGER) AS year FROM flong) GROUP BY 1, 2""",
    ("flong",),
    digits=5,
)(lambda s, f: cells(R.pivot_mean(long(s, f).withColumn("year", F.year("trade_date")), "factor_name", "year", "factor_value"), ["factor_name"], "year", "mean"))
_sk, _ku = "skewness(x)", "kurtosis(x)"
query(
    "factor_description",
    "factor_name count",
    {**{c: 4 for c in ("mean", "std", "min", "max", "q25", "q50", "q75")}, "skewness": 5, "kurtosis": 4, "missing_rate": 6},
    f"""SELECT factor_name, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, {_sk} AS skewness, {_ku} AS kurtosis,
               quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, (count(*) - count(x)) / count(*) AS missing_rate
        FROM (SELECT factor_name, factor_value AS x FROM flong) GROUP BY 1""",
    ("flong",),
)(lambda s, f: R.factor_description(panel(s, f), FACTORS))
view(
    "fstats",
    f"""SELECT factor_name, trade_date, count(x) AS valid_count, count(*) AS total_count, avg(x) AS mean_value, stddev_pop(x) AS std_value, min(x) AS min_value, max(x) AS max_value,
               count(x) / count(*) AS coverage_rate, {', '.join(f'quantile_cont(x, {p / 100}) AS p{p:02d}' for p in (5, 10, 25, 50, 75, 90, 95))}
        FROM (SELECT *, factor_value AS x FROM flong) GROUP BY 1, 2""",
    "flong",
)
query(
    "factor_statistics",
    "factor_name trade_date valid_count total_count",
    {**{c: 3 for c in ("mean_value", "std_value", "min_value", "max_value", "p05", "p10", "p25", "p50", "p75", "p90", "p95")}, "coverage_rate": 6},
    "SELECT * FROM fstats",
    ("fstats",),
)(lambda s, f: R.factor_statistics(long(s, f), ["factor_name", "trade_date"]))
query(
    "archivable_factors",
    "ts_code factor_name record_count first_date last_date",
    "",
    """SELECT ts_code, factor_name, count(*) AS record_count, min(trade_date) AS first_date, max(trade_date) AS last_date FROM flong
       WHERE trade_date < DATE '1996-06-01' GROUP BY 1, 2 HAVING count(*) > 100""",
    ("flong",),
)(lambda s, f: R.archivable(long(s, f), "1996-06-01"))
query(
    "abnormal_volume_days",
    "trade_date records too_many stale in_future",
    "past_mean past_sd",
    """SELECT *, coalesce(records > past_mean + 3 * past_sd, false) AS too_many, DATE '2001-10-01' - (SELECT max(trade_date) FROM bars) > 3 AS stale, trade_date > DATE '2001-10-01' AS in_future FROM (
         SELECT trade_date, records, avg(records) OVER w AS past_mean, stddev_samp(records) OVER w AS past_sd FROM (SELECT trade_date, count(*) AS records FROM bars GROUP BY 1)
         WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))""",
)(lambda s, f: R.abnormal_volume_days(bars(s, f), "2001-10-01"))
query(
    "incremental_progress",
    "factor_name total completed",
    "progress",
    """SELECT factor_name, count(*) AS total, count(*) FILTER (last >= DATE '2001-09-30' - 1) AS completed, count(*) FILTER (last >= DATE '2001-09-30' - 1) * 100.0 / count(*) AS progress FROM (
         SELECT s_suppkey AS ts_code, factor_name FROM supplier, (SELECT DISTINCT factor_name FROM flong)) LEFT JOIN (
         SELECT ts_code, factor_name, max(trade_date) AS last FROM flong WHERE trade_date <= DATE '2001-09-30' GROUP BY 1, 2) USING (ts_code, factor_name) GROUP BY 1""",
    ("flong",),
)(lambda s, f: R.incremental_progress(stock_basic(s, f), FACTORS, long(s, f).where(F.col("trade_date") <= F.lit("2001-09-30").cast("date")), "2001-09-30"))
query(
    "industry_prediction_rollup",
    "industry count positive_count",
    "avg_score",
    "SELECT industry, count(*) AS count, avg(weighted_score) AS avg_score, count(*) FILTER (weighted_score > 0) AS positive_count FROM scores GROUP BY 1",
    ("scores",),
)(lambda s, f: R.industry_prediction_rollup(ranked(s, f).select("industry", F.col("weighted_score").alias("score"))))
query(
    "storage_statistics",
    "factor_name record_count stock_count earliest_date latest_date",
    "",
    "SELECT factor_name, count(*) AS record_count, count(DISTINCT ts_code) AS stock_count, min(trade_date) AS earliest_date, max(trade_date) AS latest_date FROM flong GROUP BY 1",
    ("flong",),
)(lambda s, f: R.storage_statistics(long(s, f)))
query(
    "request_statistics",
    "model_name total_requests",
    "avg_response_time cache_hit_ratio error_rate",
    f"""SELECT data_source AS model_name, count(*) AS total_requests, avg(duration_seconds) AS avg_response_time, avg((retry_count = 0)::INT) AS cache_hit_ratio, avg((status = 'failed')::INT) AS error_rate
        FROM tasks WHERE CAST(created_at AS DATE) >= DATE '{AS_OF}' - 7 GROUP BY 1""",
    ("tasks",),
)(
    lambda s, f: R.request_statistics(
        M.tasks(s, f).select(
            F.col("data_source").alias("model_name"),
            F.col("duration_seconds").alias("response_time"),
            (F.col("retry_count") == 0).alias("cache_hit"),
            (F.col("status") == "failed").alias("failed"),
            F.col("created_at").alias("ts"),
        ),
        AS_OF,
    )
)
def _catalogue(spark, folder):
    """Parts as factors, of a type by size; their line items as versions, those of a late day rated."""
    name = lambda c: F.concat(F.lit("f"), c).alias("factor_name")
    factors = table(spark, folder, "part").select(name("p_partkey"), (F.col("p_size") % 5).cast("string").alias("factor_type"))
    lines = table(spark, folder, "lineitem")
    versions = lines.select(name("l_partkey"), (F.col("l_linenumber") == 1).alias("is_active"))
    quality = lines.where("l_shipdate >= TIMESTAMP '2001-01-01'").select(name("l_partkey"), (F.col("l_quantity") * 2).cast("double").alias("overall_score"))
    return factors, versions, quality


query(
    "catalogue_statistics",
    "factor_type factors versions active_versions",
    {"avg_quality": 6, "min_quality": 4, "max_quality": 4},
    """SELECT factor_type, count(*) AS factors, CAST(coalesce(sum(n), 0) AS BIGINT) AS versions, CAST(coalesce(sum(active), 0) AS BIGINT) AS active_versions, sum(qs) / nullif(sum(qn), 0) AS avg_quality, min(qmin) AS min_quality, max(qmax) AS max_quality
       FROM (SELECT p_partkey AS k, CAST(p_size % 5 AS VARCHAR) AS factor_type FROM part) f
       LEFT JOIN (SELECT l_partkey AS k, count(*) AS n, count(*) FILTER (l_linenumber = 1) AS active FROM lineitem GROUP BY 1) v ON v.k = f.k
       LEFT JOIN (SELECT l_partkey AS k, sum(l_quantity * 2) AS qs, count(l_quantity) AS qn, min(l_quantity * 2) AS qmin, max(l_quantity * 2) AS qmax FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' GROUP BY 1) q ON q.k = f.k
       GROUP BY 1""",
    (),
)(lambda s, f: R.catalogue_statistics(*_catalogue(s, f)))
query(
    "explanation_summary",
    "explanation_type count stocks",
    "avg_confidence",
    "SELECT data_source AS explanation_type, count(*) AS count, count(DISTINCT user_id) AS stocks, avg(progress) AS avg_confidence FROM tasks GROUP BY 1",
    ("tasks",),
)(
    lambda s, f: R.explanation_summary(
        M.tasks(s, f).select(F.col("data_source").alias("explanation_type"), F.col("user_id").alias("stock_code"), F.col("progress").alias("confidence"))
    )
)
query(
    "model_summary",
    "model_name metrics_count last_monitored active_alerts",
    "avg_accuracy avg_f1_score avg_error_rate",
    """SELECT m.*, coalesce(a.n, 0) AS active_alerts FROM (SELECT model_name, count(*) AS metrics_count, avg(accuracy) AS avg_accuracy, avg(f1_score) AS avg_f1_score, avg(error_rate) AS avg_error_rate,
         max(date) AS last_monitored FROM mmetrics GROUP BY 1) m LEFT JOIN (SELECT model_name, count(*) AS n FROM malerts WHERE status = 'active' GROUP BY 1) a USING (model_name)""",
    ("mmetrics", "malerts"),
)(lambda s, f: R.model_summary(M.model_metrics(s, f), M.model_alerts(s, f)))
query(
    "model_trend",
    "date",
    "avg_accuracy avg_f1_score avg_error_rate",
    f"SELECT date, avg(accuracy) AS avg_accuracy, avg(f1_score) AS avg_f1_score, avg(error_rate) AS avg_error_rate FROM mmetrics WHERE date >= DATE '{AS_OF}' - 7 GROUP BY 1",
    ("mmetrics",),
)(lambda s, f: R.model_trend(M.model_metrics(s, f), AS_OF))
query(
    "drift_summary",
    "model_name total_checks significant_drifts",
    "avg_drift_score max_drift_score",
    "SELECT model_name, count(*) AS total_checks, count(*) FILTER (error_rate > 0.2) AS significant_drifts, avg(error_rate) AS avg_drift_score, max(error_rate) AS max_drift_score FROM mmetrics GROUP BY 1",
    ("mmetrics",),
)(lambda s, f: R.drift_summary(M.model_metrics(s, f).select("model_name", (F.col("error_rate") > 0.2).alias("is_significant"), F.col("error_rate").alias("drift_score"))))
query(
    "task_health",
    "data_type total_tasks successful_tasks",
    "avg_execution_time",
    "SELECT data_type, count(*) AS total_tasks, count(*) FILTER (status = 'success') AS successful_tasks, avg(duration_seconds) AS avg_execution_time FROM tasks GROUP BY 1",
    ("tasks",),
)(lambda s, f: R.task_health(M.tasks(s, f)))

# ---- views ----------------------------------------------------------------------------------

query(
    "latest_stock_info",
    "ts_code name industry latest_trade_date",
    {"latest_price": 8, "total_mv": 2},
    """SELECT b.ts_code, b.name, b.industry, v.trade_date AS latest_trade_date, v."close" AS latest_price, v.total_mv FROM basic b
       LEFT JOIN (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1) v USING (ts_code) WHERE b.list_status = 'L'""",
    ("basic", "valued"),
)(
    lambda s, f: stock_basic(s, f).where(F.col("list_status") == "L").join(
        J.latest_row(daily_basic(s, f).select("ts_code", F.col("trade_date").alias("latest_trade_date"), F.col("close").alias("latest_price"), "total_mv"), "ts_code", "latest_trade_date"),
        "ts_code",
        "left",
    )
)
query(
    "latest_factor_scores",
    "ts_code trade_date name",
    {"score": 8},
    """SELECT s.ts_code, s.trade_date, b.name, s.score FROM scores s JOIN basic b USING (ts_code)
       WHERE s.trade_date = (SELECT max(trade_date) FROM panel p WHERE p.ts_code = s.ts_code) AND b.list_status = 'L'""",
    ("scores", "basic"),
)(
    lambda s, f: J.latest_day_rows(ranked(s, f).drop("industry"), "ts_code", "trade_date").join(
        stock_basic(s, f).where(F.col("list_status") == "L").select("ts_code", "name"), "ts_code"
    )
)
query(
    "factor_overview",
    "factor_name calculation_date total_count valid_count",
    "coverage_rate",
    """SELECT factor_name, trade_date AS calculation_date, total_count, valid_count, coverage_rate FROM fstats s
       WHERE trade_date = (SELECT max(trade_date) FROM fstats t WHERE t.factor_name = s.factor_name)""",
    ("fstats",),
)(lambda s, f: J.latest_day_rows(R.factor_statistics(long(s, f), ["factor_name", "trade_date"]), "factor_name", "trade_date").withColumnRenamed("trade_date", "calculation_date"))
query(
    "latest_factors",
    "ts_code trade_date",
    "mom volr rng",
    "SELECT ts_code, trade_date, mom, volr, rng FROM panel WHERE trade_date = (SELECT max(trade_date) FROM panel)",
    ("panel",),
)(lambda s, f: J.global_latest_rows(panel(s, f), "trade_date"))
query(
    "score_summary",
    "ts_code name trade_date score_grade",
    "rank_percentile",
    """SELECT *, CASE WHEN rank_percentile <= 0.2 THEN 'A' WHEN rank_percentile <= 0.4 THEN 'B' WHEN rank_percentile <= 0.6 THEN 'C' WHEN rank_percentile <= 0.8 THEN 'D' ELSE 'E' END AS score_grade FROM (
         SELECT p.ts_code, b.name, p.trade_date, rank_overall / count(*) OVER (PARTITION BY trade_date) AS rank_percentile FROM placed p LEFT JOIN basic b USING (ts_code))
       WHERE trade_date = (SELECT max(cal_date) FROM calendar WHERE is_open = 1)""",
    ("placed", "basic", "calendar"),
)(
    lambda s, f: R.score_summary(
        J.global_latest_rows(ranked(s, f), "trade_date").transform(
            lambda d: d.crossJoin(F.broadcast(d.agg(F.count("*").alias("_n")))).withColumn("rank_percentile", F.col("rank_overall") / F.col("_n"))
        ),
        stock_basic(s, f),
        calendar(s, f),
    )
)
query(
    "comprehensive_view",
    "ts_code trade_date name industry",
    {"close": 8, "mom": 5, "rng": 5, "total_mv": 2},
    """SELECT ts_code, trade_date, name, b.industry, p."close", p.mom, p.rng, v.total_mv FROM panel p LEFT JOIN basic b USING (ts_code) LEFT JOIN valued v USING (ts_code, trade_date)""",
    ("panel", "basic", "valued"),
)(
    lambda s, f: J.wide_security_view(
        stock_basic(s, f).select("ts_code", "name", "industry"),
        bars(s, f).select("ts_code", "trade_date", "close"),
        panel(s, f).select("ts_code", "trade_date", "mom", "rng"),
        daily_basic(s, f).select("ts_code", "trade_date", "total_mv"),
    )
)
