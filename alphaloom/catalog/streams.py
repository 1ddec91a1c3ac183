"""Streaming queries over the events, run to completion with available-now triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.catalog import monitoring as M
from alphaloom.catalog.base import query, view
from alphaloom.session import scratch_path
from alphaloom.sources.tables import table
from alphaloom.streaming import alerts as A
from alphaloom.streaming import checks, tasks
from alphaloom.streaming import metrics as S
from alphaloom.streaming import windows as W


def stream(spark, folder):
    return S.read_stream(spark, f"{folder}/events*.parquet", table(spark, folder, "events").schema)


def halves(spark, folder):
    """The same events as a stream of two batches, the earlier half first."""
    path, events = scratch_path(spark, "halves"), table(spark, folder, "events")
    middle = events.agg(F.expr("percentile_approx(ts, 0.5)").alias("middle"))
    placed = events.crossJoin(F.broadcast(middle))  # one row
    for k, half in enumerate((F.col("ts") <= F.col("middle"), (F.col("ts") > F.col("middle")) | F.col("ts").isNull())):
        placed.where(half).drop("middle").write.parquet(f"{path}/{k}")
    files = len(spark.read.parquet(f"{path}/0").inputFiles())
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", str(files)).parquet(f"{path}/*")


def metrics(spark, folder):
    return S.as_metrics(halves(spark, folder), "event_type", "ts", "value", "10 minutes")


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


query(
    "stream_last_points",
    "name ts rank",
    {"value": 4},
    """SELECT event_type AS name, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS rank FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) <= 1000""",
    (),
)(lambda s, f: ntz(S.last_points(S.drain(metrics(s, f))), "ts"))

_closed = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
_STATS = """count(value) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean, quantile_disc(value, 0.5) AS median, stddev_pop(value) AS std, arg_max(value, ts) AS latest"""
def stats(spark, folder, *span):
    return ntz(W.closed_windows(metrics(spark, folder), scratch_path(spark, "windows"), W.value_figures(), *span), "window_start", "window_end")


query(
    "stream_window_stats",
    "window_start window_end name count",
    "min max mean median std latest",
    f"""SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type AS name, {_STATS} FROM events GROUP BY 1, 2, 3)
        WHERE window_end <= {_closed}""",
    (),
)(lambda s, f: stats(s, f, "1 hour"))
query(
    "stream_sliding_stats",
    "window_start window_end name count",
    "min max mean median std latest",
    f"""SELECT * FROM (SELECT b - k * INTERVAL 30 MINUTE AS window_start, b - k * INTERVAL 30 MINUTE + INTERVAL 2 HOUR AS window_end, name, {_STATS} FROM (
          SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, event_type AS name, ts, value, unnest([0, 1, 2, 3]) AS k FROM events) GROUP BY 1, 2, 3) WHERE window_end <= {_closed}""",
    (),
)(lambda s, f: stats(s, f, "2 hours", "30 minutes"))


def requests(spark, folder):
    e = stream(spark, folder).select(
        F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("event_type") != "error").alias("ok"), (F.col("user_id") < 30).alias("cached")
    )
    return e.withWatermark("ts", "10 minutes")


query(
    "stream_request_monitor",
    "window_start window_end requests",
    "success_rate cache_hit_rate avg_time",
    f"""SELECT * FROM (SELECT b - k * INTERVAL 30 MINUTE AS window_start, b - k * INTERVAL 30 MINUTE + INTERVAL 1 HOUR AS window_end, count(*) AS requests, avg((event_type <> 'error')::INT) AS success_rate,
              avg((user_id < 30)::INT) AS cache_hit_rate, avg(value) AS avg_time FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) AS b, unnest([0, 1]) AS k FROM events) GROUP BY 1, 2) WHERE window_end <= {_closed}""",
    (),
)(lambda s, f: ntz(W.closed_windows(requests(s, f), scratch_path(s, "requests"), W.request_figures(), "1 hour", "30 minutes"), "window_start", "window_end"))


def rules(spark, folder):
    """A rule per event type: fire after three values above the type's mean, at most every two hours."""
    e = table(spark, folder, "events").groupBy("event_type").agg(F.round(F.avg("value") * 0.8, 2).alias("threshold"))
    return e.select(
        F.concat(F.lit("rule_"), "event_type").alias("rule_id"),
        F.col("event_type").alias("metric"),
        "threshold",
        F.lit(">").alias("comparison"),
        F.lit(3).alias("trigger_count"),
        F.lit(7200).alias("evaluation_window"),
        (F.col("event_type") != "view").alias("enabled"),
    )


def fired(spark, folder):
    return A.alerts(metrics(spark, folder), rules(spark, folder))


view(
    "hits",
    """SELECT 'rule_' || event_type AS rule_id, ts, value, value > threshold AS hit, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS i
       FROM events JOIN (SELECT event_type, round(avg(value) * 0.8, 2) AS threshold FROM events GROUP BY 1) USING (event_type) WHERE event_type <> 'view'""",
)
_CHAIN = """WITH RECURSIVE chain AS (
    SELECT DISTINCT rule_id, 0::BIGINT AS i, 0 AS n, NULL::TIMESTAMP AS last, NULL::TIMESTAMP AS fired_at, NULL::DOUBLE AS value, 0 AS hits FROM hits
    UNION ALL
    SELECT rule_id, i, CASE WHEN hit AND NOT f THEN n + 1 ELSE 0 END AS n, CASE WHEN f THEN ts ELSE last END AS last, CASE WHEN f THEN ts END AS fired_at, CASE WHEN f THEN value END AS value,
           CASE WHEN f THEN n + 1 ELSE 0 END AS hits
    FROM (SELECT h.rule_id, h.i, h.ts, h.value, h.hit, c.n, c.last, h.hit AND c.n + 1 >= 3 AND (c.last IS NULL OR epoch_us(h.ts) - epoch_us(c.last) >= 7200000000) AS f
          FROM chain c JOIN hits h ON h.rule_id = c.rule_id AND h.i = c.i + 1) x)
SELECT rule_id, fired_at, value, CAST(hits AS INTEGER) AS hits FROM chain WHERE fired_at IS NOT NULL"""
query("stream_alerts", "rule_id fired_at hits", {"value": 4}, _CHAIN, ("hits",))(lambda s, f: ntz(fired(s, f), "fired_at"))


def suppressed(spark, folder):
    """Long tasks as alerts titled by their type, let through at most every six hours."""
    e = halves(spark, folder).where(F.col("value") > 100)
    return A.suppress(e.select(F.col("event_type").alias("title"), F.col("ts").cast("timestamp").alias("fired_at"), "value"), 360)


query(
    "stream_suppressed_alerts",
    "title fired_at",
    {"value": 4},
    """WITH RECURSIVE a AS (SELECT event_type AS title, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events WHERE value > 100),
       chain AS (SELECT title, i, ts AS last, ts AS fired_at, value FROM a WHERE i = 1
         UNION ALL SELECT a.title, a.i, CASE WHEN epoch_us(a.ts) - epoch_us(c.last) > 21600000000 THEN a.ts ELSE c.last END, CASE WHEN epoch_us(a.ts) - epoch_us(c.last) > 21600000000 THEN a.ts END, a.value
         FROM chain c JOIN a ON a.title = c.title AND a.i = c.i + 1)
       SELECT title, fired_at, value FROM chain WHERE fired_at IS NOT NULL""",
    (),
)(lambda s, f: ntz(suppressed(s, f), "fired_at"))


@query(
    "stream_batch_checks",
    "rows duplicates dates_unique",
    {"null_ratio": 6, "anomaly_ratio": 6, "overall_score": 4, "mean_value": 4, "std_value": 4},
    """SELECT rows, duplicates, duplicates = 0 AS dates_unique, 0.0::DOUBLE AS null_ratio, anomaly_ratio, (100 + greatest(0, 100 - 100 * anomaly_ratio) + CASE WHEN duplicates = 0 THEN 100 ELSE 50 END) / 3 AS overall_score, mean_value, std_value
       FROM (SELECT count(*) AS rows, count(*) - count(DISTINCT (user_id, ts)) AS duplicates, avg((abs(value - m) / nullif(d, 0) > 6)::INT) AS anomaly_ratio, avg(value) AS mean_value, stddev_pop(value) AS std_value
             FROM events, (SELECT median(value) AS m, mad(value) AS d FROM events) q)""",
    (),
)
def stream_batch_checks(spark, folder):
    path = scratch_path(spark, "checks")
    rows = stream(spark, folder).select(F.col("user_id").alias("ts_code"), F.col("ts").alias("trade_date"), "value", "event_type")
    checks.check_batches(rows, ["value"], path)
    return checks.running_result(spark, path)


@query(
    "stream_decayed_quantiles",
    "factor_name quantile count",
    {"min_value": 4, "max_value": 4, "mean_value": 6, "std_value": 6},
    """SELECT factor_name, CAST(b AS INTEGER) AS quantile, count(*) AS count, min(value) AS min_value, max(value) AS max_value, avg(value) AS mean_value, stddev_samp(value) AS std_value FROM (
         SELECT event_type AS factor_name, value, 1 + (value > e[2])::INT + (value > e[3])::INT + (value > e[4])::INT + (value > e[5])::INT AS b FROM events
         JOIN (SELECT event_type, quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM events GROUP BY 1) USING (event_type)) GROUP BY 1, 2""",
    (),
)
def stream_decayed_quantiles(spark, folder):
    path = scratch_path(spark, "decayed")
    S.decay_quantiles(stream(spark, folder).select(F.col("event_type").alias("factor_name"), F.col("value").alias("factor_value")), path)
    stored = spark.read.parquet(path)
    return stored.join(stored.agg(F.max("epoch").alias("epoch")), "epoch", "left_semi")


def updates(spark, folder):
    """Events as updates of one task per user."""
    v = F.col("value")
    return stream(spark, folder).select(
        F.col("user_id").alias("task_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(v < 10, "failed").when(v < 40, "completed").otherwise("running").alias("status"),
        F.least(v, F.lit(100.0)).alias("progress"),
        (v * 100).cast("long").alias("records"),
    )


@query(
    "stream_task_progress",
    "task_id status updates",
    {"progress": 4},
    """SELECT user_id AS task_id, CASE WHEN v < 10 THEN 'failed' WHEN v < 40 THEN 'completed' WHEN newest + INTERVAL 2 DAY < until - INTERVAL 10 MINUTE THEN 'expired' ELSE 'running' END AS status, n AS updates, least(v, 100.0) AS progress FROM (
         SELECT user_id, arg_max(value, ts) AS v, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1), (SELECT max(ts) AS until FROM events) u""",
    (),
)
def stream_task_progress(spark, folder):
    path = scratch_path(spark, "progress_table")
    tasks.follow_tasks(updates(spark, folder).withWatermark("ts", "10 minutes"), path, "2 days")
    return tasks.results(spark, path).withColumn("task_id", F.col("task_id").cast("long"))


query(
    "active_tasks",
    "task_id status duration_seconds",
    {"records_per_second": 6},
    """SELECT user_id AS task_id, 'running' AS status, d AS duration_seconds, CAST(CAST(v * 100 AS DECIMAL(18, 0)) AS DOUBLE) / nullif(d, 0) AS records_per_second FROM (
         SELECT user_id, arg_max(value, ts) AS v, CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS d FROM events GROUP BY 1) WHERE v >= 40""",
    (),
)(
    lambda s, f: S.active_only(
        S.task_progress(
            table(s, f, "events").select(
                F.col("user_id").alias("task_id"),
                F.col("ts").cast("timestamp").alias("ts"),
                F.when(F.col("value") < 10, "failed").when(F.col("value") < 40, "completed").otherwise("running").alias("status"),
                F.lit(0.0).alias("progress"),
                F.round(F.col("value") * 100).cast("long").alias("records"),
            )
        )
    )
)
query(
    "alert_statistics",
    "severity alert_type n active",
    "",
    """SELECT severity, alert_type, count(*) AS n, count(*) FILTER (status = 'active') AS active FROM malerts
       WHERE created_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2""",
    ("malerts",),
)(lambda s, f: S.alert_statistics(M.model_alerts(s, f), "2024-01-20 00:00:00"))
