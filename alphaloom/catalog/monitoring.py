"""Task, quality-metric and model tables derived from events, shared by several catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.catalog.base import view
from alphaloom.sources.tables import table

AS_OF = "2024-01-30"


def tasks(spark, folder):
    """Every event as a task run: its value is the duration, ranges of it give the status."""
    v = F.col("value")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("task_id"),
        F.col("event_type").alias("data_source"),
        F.when(F.col("user_id") < 30, "daily").when(F.col("user_id") < 60, "minute").otherwise("report").alias("data_type"),
        F.when(v < 10, "failed").when(v < 60, "success").when(v < 100, "running").otherwise("pending").alias("status"),
        v.alias("duration_seconds"),
        F.least(v, F.lit(100.0)).alias("progress"),
        (F.col("user_id") % 4).cast("int").alias("retry_count"),
        F.col("user_id"),
        F.col("ts").alias("created_at"),
    )


view(
    "tasks",
    """SELECT event_id AS task_id, event_type AS data_source, CASE WHEN user_id < 30 THEN 'daily' WHEN user_id < 60 THEN 'minute' ELSE 'report' END AS data_type,
              CASE WHEN value < 10 THEN 'failed' WHEN value < 60 THEN 'success' WHEN value < 100 THEN 'running' ELSE 'pending' END AS status,
              value AS duration_seconds, least(value, 100.0) AS progress, CAST(user_id % 4 AS INTEGER) AS retry_count, user_id, ts AS created_at FROM events""",
)


def quality_metrics(spark, folder):
    """Daily score per source and type: the share of tasks that did not fail."""
    score = F.avg(F.when(F.col("status") == "failed", 0.0).otherwise(100.0))
    out = tasks(spark, folder).groupBy("data_source", "data_type", F.to_date("created_at").alias("report_date")).agg(score.alias("overall_score"))
    s = F.col("overall_score")
    level = F.when(s < 60, "critical").when(s < 75, "poor").when(s < 85, "fair").when(s < 95, "good").otherwise("excellent")
    return out.withColumn("quality_level", level)


view(
    "qmetrics",
    """SELECT *, CASE WHEN overall_score < 60 THEN 'critical' WHEN overall_score < 75 THEN 'poor' WHEN overall_score < 85 THEN 'fair' WHEN overall_score < 95 THEN 'good' ELSE 'excellent' END AS quality_level
       FROM (SELECT data_source, data_type, CAST(created_at AS DATE) AS report_date, avg(CASE WHEN status = 'failed' THEN 0.0 ELSE 100.0 END) AS overall_score FROM tasks GROUP BY 1, 2, 3)""",
    "tasks",
)


def anomalies(spark, folder):
    """Long tasks as anomalies."""
    return tasks(spark, folder).where(F.col("duration_seconds") > 100).select(
        "data_source",
        "data_type",
        F.when(F.col("duration_seconds") > 200, "extreme").otherwise("high").alias("anomaly_type"),
        F.when(F.col("retry_count") == 0, "fixed").when(F.col("retry_count") < 3, "detected").otherwise("ignored").alias("status"),
        F.col("duration_seconds").alias("anomaly_score"),
        F.to_date("created_at").alias("anomaly_date"),
    )


view(
    "anomalies",
    """SELECT data_source, data_type, CASE WHEN duration_seconds > 200 THEN 'extreme' ELSE 'high' END AS anomaly_type,
              CASE WHEN retry_count = 0 THEN 'fixed' WHEN retry_count < 3 THEN 'detected' ELSE 'ignored' END AS status, duration_seconds AS anomaly_score,
              CAST(created_at AS DATE) AS anomaly_date FROM tasks WHERE duration_seconds > 100""",
    "tasks",
)


def model_metrics(spark, folder):
    """Daily model figures: one model per event type."""
    t = tasks(spark, folder)
    ok = F.avg((F.col("status") == "success").cast("double"))
    return t.groupBy(F.col("data_source").alias("model_name"), F.to_date("created_at").alias("date")).agg(
        ok.alias("accuracy"),
        (ok * 0.9).alias("f1_score"),
        F.avg((F.col("status") == "failed").cast("double")).alias("error_rate"),
        F.count("*").alias("prediction_count"),
    )


view(
    "mmetrics",
    """SELECT data_source AS model_name, CAST(created_at AS DATE) AS date, avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0 END) AS accuracy,
              avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0 END) * 0.9 AS f1_score, avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0 END) AS error_rate, count(*) AS prediction_count
       FROM tasks GROUP BY 1, 2""",
    "tasks",
)


def model_alerts(spark, folder):
    return tasks(spark, folder).where(F.col("status") == "failed").select(
        F.col("data_source").alias("model_name"),
        F.when(F.col("retry_count") < 2, "active").otherwise("resolved").alias("status"),
        F.col("created_at"),
        F.when(F.col("duration_seconds") < 3, "critical").otherwise("warning").alias("severity"),
        F.col("data_type").alias("alert_type"),
    )


view(
    "malerts",
    """SELECT data_source AS model_name, CASE WHEN retry_count < 2 THEN 'active' ELSE 'resolved' END AS status, created_at, CASE WHEN duration_seconds < 3 THEN 'critical' ELSE 'warning' END AS severity,
              data_type AS alert_type FROM tasks WHERE status = 'failed'""",
    "tasks",
)
