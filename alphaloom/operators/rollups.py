"""Rollups and views over task, quality, model and factor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.scalars import grade_by_percentile
from alphaloom.functions.stats import sample_kurtosis, sample_skew
from alphaloom.operators import crosssection as X


def recent(df: DataFrame, time: str, as_of, days: int) -> DataFrame:
    return df.where(F.col(time).cast("date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def level_counts(col: str, levels) -> list[Column]:
    return [F.count_if(F.col(col) == v).alias(f"{v}_count") for v in levels]


def quality_summary(metrics: DataFrame, as_of, days: int = 30) -> DataFrame:
    return recent(metrics, "report_date", as_of, days).groupBy("data_source", "data_type").agg(
        F.avg("overall_score").alias("avg_score"),
        F.min("overall_score").alias("min_score"),
        F.max("overall_score").alias("max_score"),
        F.count("*").alias("report_count"),
        *level_counts("quality_level", ("critical", "poor", "fair", "good", "excellent")),
        F.max("report_date").alias("latest_report_date"),
    )


def anomaly_summary(anomalies: DataFrame, as_of, days: int = 30) -> DataFrame:
    return recent(anomalies, "anomaly_date", as_of, days).groupBy("data_source", "data_type", "anomaly_type").agg(
        F.count("*").alias("anomaly_count"),
        F.count_if(F.col("status") == "fixed").alias("fixed_count"),
        F.count_if(F.col("status") == "detected").alias("pending_count"),
        F.avg("anomaly_score").alias("avg_anomaly_score"),
        F.max("anomaly_date").alias("latest_anomaly_date"),
    )


def null_duplicate_ratios(checks: DataFrame) -> DataFrame:
    """Percentages rounded to two places; an empty table gives 0."""

    def share(c):
        return F.when(F.col("total_records") > 0, F.round(F.col(c) / F.col("total_records") * 100, 2)).otherwise(0.0)

    return checks.withColumns({"null_percentage": share("null_records"), "duplicate_percentage": share("duplicate_records")})


def validity_overview(checks: DataFrame, by: str = "table_name") -> DataFrame:
    ok = F.count_if("is_valid")
    return checks.groupBy(by).agg(
        F.count("*").alias("total_records"),
        ok.alias("valid_records"),
        F.count_if(~F.col("is_valid")).alias("invalid_records"),
        F.round(ok * 100.0 / F.count("*"), 2).alias("valid_percentage"),
        F.max("last_updated").alias("last_updated"),
    )


def test_summary(results: DataFrame) -> DataFrame:
    """Outcome counts and times per session and phase."""
    return results.groupBy("test_session_id", "test_phase").agg(
        F.count("*").alias("total_tests"),
        *[F.count_if(F.col("test_status") == s).alias(f"{s}_tests") for s in ("passed", "failed", "skipped")],
        F.round(F.avg("execution_time"), 3).alias("avg_execution_time"),
        F.min("created_at").alias("start_time"),
        F.max("created_at").alias("end_time"),
    )


def task_statistics(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("data_source", "data_type", "status", F.to_date("created_at").alias("execution_date")).agg(
        F.count("*").alias("task_count"),
        F.avg("duration_seconds").alias("avg_duration_seconds"),
        F.min("duration_seconds").alias("min_duration_seconds"),
        F.max("duration_seconds").alias("max_duration_seconds"),
        F.avg("retry_count").alias("avg_retry_count"),
        F.count_if(F.col("retry_count") > 0).alias("tasks_with_retries"),
    )


def resource_usage(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("allocation_time").alias("usage_date"), F.hour("allocation_time").alias("usage_hour")).agg(
        F.avg("cpu").alias("avg_cpu_usage"),
        F.max("cpu").alias("peak_cpu_usage"),
        F.sum("api_calls").alias("total_api_calls"),
        F.count_distinct("task_id").alias("concurrent_tasks"),
    )


def status_progress(tasks: DataFrame) -> DataFrame:
    """Tasks by status with their share of all; one row per status."""
    out = tasks.groupBy("status").agg(F.count("*").alias("count"), F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("avg_duration"))
    return out.withColumn("percentage", F.col("count") / F.sum("count").over(W.partitionBy()) * 100)


def hourly_throughput(tasks: DataFrame, as_of) -> DataFrame:
    """Tasks started in the hour before ``as_of``."""
    until = F.lit(as_of).cast("timestamp_ntz")
    last = tasks.where((F.col("created_at") >= until - F.expr("INTERVAL 1 HOUR")) & (F.col("created_at") <= until))
    return last.agg(
        F.count("*").alias("total_tasks"),
        F.count_if(F.col("status") == "success").alias("completed_tasks"),
        F.count_if(F.col("status") == "failed").alias("failed_tasks"),
        F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("avg_duration"),
    )


def active_dashboard(tasks: DataFrame) -> DataFrame:
    """Counts of running and pending tasks by status, source and type in one pass."""
    active = tasks.where(F.col("status").isin("running", "pending"))
    cells = active.groupingSets([["status"], ["data_source"], ["data_type"]], "status", "data_source", "data_type").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("progress").alias("avg_progress")
    )
    kind = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "data_source").otherwise("data_type")
    return cells.select(kind.alias("kind"), F.coalesce("status", "data_source", "data_type").alias("name"), "n", "avg_progress")


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts of the values of several columns as rows of (column, value, n)."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def pivot_first(df: DataFrame, keys: list[str], names: list[str], name: str = "factor_name", value: str = "factor_value") -> DataFrame:
    """Long to wide with the first value per cell."""
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value, ignorenulls=True))


def pivot_mean(df: DataFrame, row: str, col: str, value: str, names: list | None = None) -> DataFrame:
    """Means of each row and column value; all column values of the data unless some are named."""
    return df.groupBy(row).pivot(col, names).agg(F.avg(value))


def factor_description(df: DataFrame, factors: list[str]) -> DataFrame:
    """Count, moments, quartiles and missing share per factor.

    Quartiles come from the exact quantile operator, which holds for any number of rows.
    """
    long = df.select(*factors).unpivot([], factors, "factor_name", "x")
    x = F.col("x")
    moments = long.groupBy("factor_name").agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        sample_skew(x).alias("skewness"),
        sample_kurtosis(x).alias("kurtosis"),
        (F.count_if(x.isNull()) / F.count("*")).alias("missing_rate"),
    )
    quart = X.group_quantiles(long, "factor_name", "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quart, "factor_name")


def factor_statistics(df: DataFrame, by: list[str], value: str = "factor_value") -> DataFrame:
    """Coverage, population spread and percentiles of a long factor table."""
    base = df.groupBy(*by).agg(
        F.count(value).alias("valid_count"),
        F.count("*").alias("total_count"),
        F.avg(value).alias("mean_value"),
        F.stddev_pop(value).alias("std_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    ).withColumn("coverage_rate", F.col("valid_count") / F.col("total_count"))
    probs = {f"p{p:02d}": p / 100 for p in (5, 10, 25, 50, 75, 90, 95)}
    return X.join_groups(base, X.group_quantiles(df, by, value, probs), by)


def archivable(df: DataFrame, before, min_rows: int = 100) -> DataFrame:
    """Old rows per security and factor where there are more than ``min_rows``."""
    old = df.where(F.col("trade_date") < F.lit(before).cast("date"))
    out = old.groupBy("ts_code", "factor_name").agg(F.count("*").alias("record_count"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    return out.where(F.col("record_count") > min_rows)


def abnormal_volume_days(df: DataFrame, as_of, days: int = 30, time: str = "trade_date") -> DataFrame:
    """Daily row counts judged against the 30 earlier days, with staleness and future rows."""
    daily = df.groupBy(time).agg(F.count("*").alias("records"))
    w = W.orderBy(time).rowsBetween(-days, -1)  # one row per day
    today = F.lit(as_of).cast("date")
    out = daily.withColumns({"past_mean": F.avg("records").over(w), "past_sd": F.stddev_samp("records").over(w)})
    newest = F.max(time).over(W.partitionBy())
    return out.withColumns(
        {
            "too_many": F.coalesce(F.col("records") > F.col("past_mean") + F.col("past_sd") * 3, F.lit(False)),
            "stale": F.datediff(today, newest) > 3,
            "in_future": F.col(time) > today,
        }
    )


def incremental_progress(codes: DataFrame, factors: list[str], values: DataFrame, as_of) -> DataFrame:
    """Per factor the securities whose last value is no older than yesterday."""
    wanted = codes.select("ts_code").distinct().withColumn("factor_name", F.explode(F.array(*[F.lit(f) for f in factors])))
    last = values.groupBy("ts_code", "factor_name").agg(F.max("trade_date").alias("last_date"))
    done = F.coalesce(F.col("last_date") >= F.date_sub(F.lit(as_of).cast("date"), 1), F.lit(False))
    out = wanted.join(last, ["ts_code", "factor_name"], "left").groupBy("factor_name").agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed")
    )
    return out.withColumn("progress", F.try_divide(F.col("completed") * 100.0, F.col("total")))


def industry_prediction_rollup(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("industry").agg(
        F.count("*").alias("count"), F.avg("score").alias("avg_score"), F.count_if(F.col("score") > 0).alias("positive_count")
    )


def storage_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("factor_name").agg(
        F.count("*").alias("record_count"),
        F.count_distinct("ts_code").alias("stock_count"),
        F.min("trade_date").alias("earliest_date"),
        F.max("trade_date").alias("latest_date"),
    )


def request_statistics(requests: DataFrame, as_of, days: int = 7) -> DataFrame:
    return recent(requests, "ts", as_of, days).groupBy("model_name").agg(
        F.count("*").alias("total_requests"),
        F.avg("response_time").alias("avg_response_time"),
        F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_ratio"),
        F.avg(F.col("failed").cast("double")).alias("error_rate"),
    )


def explanation_summary(explanations: DataFrame) -> DataFrame:
    return explanations.groupBy("explanation_type").agg(
        F.count("*").alias("count"), F.count_distinct("stock_code").alias("stocks"), F.avg("confidence").alias("avg_confidence")
    )


def model_summary(metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """Monitoring figures per model with its active alerts, by one join."""
    active = alerts.where(F.col("status") == "active").groupBy("model_name").agg(F.count("*").alias("active_alerts"))
    out = metrics.groupBy("model_name").agg(
        F.count("*").alias("metrics_count"),
        F.avg("accuracy").alias("avg_accuracy"),
        F.avg("f1_score").alias("avg_f1_score"),
        F.avg("error_rate").alias("avg_error_rate"),
        F.max("date").alias("last_monitored"),
    )
    return out.join(active, "model_name", "left").fillna(0, ["active_alerts"])


def model_trend(metrics: DataFrame, as_of, days: int = 7) -> DataFrame:
    return recent(metrics, "date", as_of, days).groupBy("date").agg(
        F.avg("accuracy").alias("avg_accuracy"), F.avg("f1_score").alias("avg_f1_score"), F.avg("error_rate").alias("avg_error_rate")
    )


def drift_summary(drift: DataFrame) -> DataFrame:
    return drift.groupBy("model_name").agg(
        F.count("*").alias("total_checks"),
        F.count_if("is_significant").alias("significant_drifts"),
        F.avg("drift_score").alias("avg_drift_score"),
        F.max("drift_score").alias("max_drift_score"),
    )


def task_health(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("data_type").agg(
        F.count("*").alias("total_tasks"), F.count_if(F.col("status") == "success").alias("successful_tasks"), F.avg("duration_seconds").alias("avg_execution_time")
    )


def catalogue_statistics(factors: DataFrame, versions: DataFrame, quality: DataFrame) -> DataFrame:
    """Factors, versions and quality by factor type."""
    v = versions.groupBy("factor_name").agg(F.count("*").alias("versions"), F.count_if("is_active").alias("active"))
    q = quality.groupBy("factor_name").agg(F.sum("overall_score").alias("qs"), F.count("overall_score").alias("qn"), F.min("overall_score").alias("qmin"), F.max("overall_score").alias("qmax"))
    joined = factors.join(v, "factor_name", "left").join(q, "factor_name", "left")
    return joined.groupBy("factor_type").agg(
        F.count("*").alias("factors"),
        F.coalesce(F.sum("versions"), F.lit(0)).alias("versions"),
        F.coalesce(F.sum("active"), F.lit(0)).alias("active_versions"),
        F.try_divide(F.sum("qs"), F.sum("qn")).alias("avg_quality"),
        F.min("qmin").alias("min_quality"),
        F.max("qmax").alias("max_quality"),
    )


def score_summary(scores: DataFrame, stocks: DataFrame, day_source: DataFrame) -> DataFrame:
    """Scores of the newest open day with the letter grade of their percentile."""
    newest = day_source.where(F.col("is_open") == 1).agg(F.max("cal_date").alias("trade_date"))
    rows = scores.join(newest, "trade_date", "left_semi").join(stocks.select("ts_code", "name"), "ts_code", "left")
    return rows.withColumn("score_grade", grade_by_percentile("rank_percentile"))
