"""Event-time windows of a stream that account for every row: counted on time, or listed as late.

Each micro-batch is reduced to one row of mergeable figures per window and group, merged with those
of open windows, and closed windows are given out when the watermark has passed their end. The
watermark of a batch is the latest time of the batches before it, less the allowed delay. A row
whose window was closed by then is written, with that window, to a table of late rows, so windows
and late rows together hold every row once for each window that it falls in.

All that is kept between batches lies in folders by epoch: figures of open windows, one row a window
and group, and the watermark. A repeated epoch reads the same state and gives the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from alphaloom.sources import sinks
from alphaloom.streaming.metrics import drain_batches

#: Size of a quantile sketch: exact up to about so many rows of a window, and beyond that the
#: rank of the median is off by less than one in a thousand.
SKETCH = 4096


@dataclass(frozen=True)
class Figures:
    """What is kept of a window: aggregates of rows, of kept figures, and the result's columns."""

    groups: tuple[str, ...]
    first: dict[str, Column]
    merge: dict[str, Column]
    final: dict[str, Column]


def value_figures() -> Figures:
    """Count, range, mean, median, population spread and newest value of each metric."""
    v = F.col("value")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    # Two parts at most are merged, an open window's and a batch's.
    both = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / (2 * F.sum("n"))
    gap = F.max("mean") - F.min("mean")
    return Figures(
        ("name",),
        {
            "n": F.count(v),
            "low": F.min(v),
            "high": F.max(v),
            "mean": F.avg(v),
            "square": F.var_pop(v) * F.count(v),
            "newest": F.max(F.when(v.isNotNull(), F.struct("ts", "value"))),
            "sketch": F.kll_sketch_agg_double(v.cast("double"), F.lit(SKETCH)),
        },
        {
            "n": n,
            "low": F.min("low"),
            "high": F.max("high"),
            "mean": mean,
            "square": F.sum("square") + F.when(both > 0, both * gap * gap).otherwise(0.0),
            "newest": F.max("newest"),
            "sketch": F.kll_merge_agg_double("sketch"),
        },
        {
            "count": F.col("n"),
            "min": F.col("low"),
            "max": F.col("high"),
            "mean": F.col("mean"),
            "median": F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))),
            "std": F.sqrt(F.col("square") / F.col("n")),
            "latest": F.col("newest.value"),
        },
    )


def request_figures() -> Figures:
    """Requests, success rate, cache hits and mean time; needs ok and cached flags."""
    sums = {"n": F.count("*"), "ok": F.sum(F.col("ok").cast("long")), "cached": F.sum(F.col("cached").cast("long")), "time": F.sum("value"), "timed": F.count("value")}
    rate = lambda c: F.col(c) / F.col("n")
    return Figures((), sums, {c: F.sum(c) for c in sums}, {"requests": F.col("n"), "success_rate": rate("ok"), "cache_hit_rate": rate("cached"), "avg_time": F.try_divide("time", "timed")})


def follow(stream: DataFrame, path: str, figures: Figures, width: str, slide: str | None = None, delay: str = "10 minutes") -> None:
    """Process a stream with a ``ts`` column to its end.

    Figures of windows go to ``path``, open and closed ones apart, late rows to ``path_late``, what a
    batch held and lost to ``path_batches``, each a folder an epoch. Rows without time belong to no window and are late.
    """
    place = ["window_start", "window_end", *figures.groups]

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = epoch > 0 and sinks.path_exists(spark, f"{path}_batches/epoch={epoch - 1}")
        mark = spark.read.parquet(f"{path}_batches/epoch={epoch - 1}").first()["watermark"] if known else None
        timed = _placed(batch, width, slide)
        closed = lambda end: F.lit(False) if mark is None else F.col(end) <= F.lit(mark)
        seen = Observation()
        judged = timed.withColumn("late", closed("window_end"))
        judged = judged.observe(seen, F.count("*").alias("rows"), F.count_if("late").alias("late"), F.max("ts").alias("newest"))
        none = F.lit(None).cast("timestamp")
        untimed = batch.where("ts IS NULL").withColumns({"window_start": none, "window_end": none})
        judged.where("late").drop("late").unionByName(untimed).write.mode("overwrite").parquet(f"{path}_late/epoch={epoch}")
        told = seen.get
        newest = told["newest"]
        after = spark.range(1).select(F.greatest(F.lit(mark).cast("timestamp"), F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")).alias("watermark")).first()[0]

        fresh = timed.where(~closed("window_end")).groupBy(*place).agg(*(c.alias(n) for n, c in figures.first.items()))
        merged = fresh
        if known:
            before = _figures(spark, f"{path}/epoch={epoch - 1}", fresh.schema).where("open").drop("open")
            merged = fresh.unionByName(before).groupBy(*place).agg(*(c.alias(n) for n, c in figures.merge.items())).select(*fresh.columns)
        passed = F.lit(False) if after is None else F.col("window_end") <= F.lit(after)
        # Static: what an attempt that was cut off has left in this epoch goes.
        merged.withColumn("open", ~passed).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("open").parquet(f"{path}/epoch={epoch}")
        # Last: it says that the epoch is complete.
        line = spark.createDataFrame([(told["rows"], told["late"], after)], "rows long, late long, watermark timestamp")
        line.write.mode("overwrite").parquet(f"{path}_batches/epoch={epoch}")

    drain_batches(stream, each)


def _figures(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("open", BooleanType())])).parquet(path)


def _placed(batch: DataFrame, width: str, slide: str | None) -> DataFrame:
    """Rows with a time, once for each window that they fall in."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return batch.where("ts IS NOT NULL").withColumn("_w", span).withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")


def closed_windows(stream: DataFrame, path: str, figures: Figures, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """The windows that the stream closes, one row a window and group."""
    follow(stream, path, figures, width, slide, delay)
    spark = stream.sparkSession
    none = spark.createDataFrame([], stream.schema)
    place = ["window_start", "window_end", *figures.groups]
    kept = _placed(none, width, slide).groupBy(*place).agg(*(c.alias(n) for n, c in figures.first.items()))
    rows = _figures(spark, path, kept.schema).where("NOT open") if sinks.path_exists(spark, path) else kept
    return rows.select(*place, *(c.alias(n) for n, c in figures.final.items()))


def late_rows(spark, path: str) -> DataFrame:
    """Rows behind the watermark, each with the window that it came too late for."""
    return spark.read.parquet(f"{path}_late").drop("epoch")


def late_counts(spark, path: str, by: str = "name") -> DataFrame:
    """Late rows of each metric."""
    return late_rows(spark, path).groupBy(by).agg(F.count("*").alias("late"))


def batch_counts(spark, path: str) -> DataFrame:
    """Rows, late rows and the watermark after each batch."""
    return spark.read.parquet(f"{path}_batches")
