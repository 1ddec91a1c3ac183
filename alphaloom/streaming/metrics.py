"""Metric streams: points, windowed figures, rule hits and running bucket statistics.

A stream is ``(name, ts, value)`` with event time. Late rows beyond the watermark are dropped.
Cool-downs use event time, so a replay gives the same alerts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from alphaloom.functions.scalars import compare
from alphaloom.operators import crosssection as X
from alphaloom.operators import preprocess as P
from alphaloom.session import scratch_path
from alphaloom.sources import sinks


def read_stream(spark: SparkSession, path: str, schema: StructType, max_bytes: int = 1 << 30) -> DataFrame:
    """Parquet files of a folder or pattern as a stream; a trigger takes about ``max_bytes``."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(path)


def as_metrics(events: DataFrame, name: str, ts: str, value: str, watermark: str = "10 minutes") -> DataFrame:
    out = events.select(F.col(name).alias("name"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).alias("value"))
    return out.withWatermark("ts", watermark)


def drain(stream: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Process everything available into a Parquet folder and return it as a table."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", path + "_progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, each, mode: str = "append") -> StreamingQuery:
    """Process everything available through ``each(batch, epoch)``; the ended query tells of its progress."""
    query = (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", scratch_path(stream.sparkSession, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def last_points(metrics: DataFrame, n: int = 1000) -> DataFrame:
    """Newest ``n`` points per metric of an ingested table."""
    return X.top_per_group(metrics, "name", [F.desc("ts"), F.desc("value")], n)


def rule_hits(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Match points with enabled rules of their metric and test the condition.

    An equal join by metric, whose side and way the optimiser picks by size.
    """
    on = rules.where("enabled").select("rule_id", F.col("metric").alias("name"), "threshold", "comparison", "trigger_count", "evaluation_window")
    return metrics.join(on, "name").withColumn("hit", compare("value", "threshold", "comparison"))


def decay_quantiles(values: DataFrame, path: str, buckets: int = 5, decay: float = 0.95) -> None:
    """Blend each micro-batch's bucket statistics into the running ones, one small table per epoch.

    ``values`` needs factor_name and factor_value. An epoch reads the result of the one before,
    so a repeated epoch gives the same table. A bucket that a batch doesn't hold keeps its state.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        stats = P.quantile_stats(P.market_quantiles(batch, "factor_value", buckets, "factor_name"), "factor_value", "factor_name")
        before = f"{path}/epoch={epoch - 1}"
        if epoch > 0 and sinks.path_exists(spark, before):
            stats = P.update_quantiles(stats, spark.read.parquet(before), ("factor_name", "quantile"), decay, keep=True)
        stats.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    drain_batches(values, each)


def task_progress(updates: DataFrame) -> DataFrame:
    """Newest state of every task, as an update stream keyed by task."""
    fields = F.struct("status", "progress", "records")
    return updates.groupBy("task_id").agg(
        F.max_by(fields, "ts").alias("s"), F.min("ts").alias("started"), F.max("ts").alias("updated"), F.count("*").alias("updates")
    ).select("task_id", "s.*", "started", "updated", "updates")


def active_only(progress: DataFrame) -> DataFrame:
    """Unfinished tasks with run time and throughput."""
    seconds = F.unix_timestamp("updated") - F.unix_timestamp("started")
    return progress.where(~F.col("status").isin("completed", "failed")).withColumns(
        {"duration_seconds": seconds, "records_per_second": F.try_divide(F.col("records"), seconds)}
    )


def alert_statistics(alerts_table: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Alerts of the last hours by severity and type."""
    until = F.lit(as_of).cast("timestamp")
    recent: Column = (F.col("created_at") > until - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("created_at") <= until)
    return alerts_table.where(recent).groupBy("severity", "alert_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"))
