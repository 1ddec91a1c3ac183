"""Quality checks over the batches of a stream, with running figures and duplicates across batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.operators.quality import robust_anomalies
from alphaloom.sources import sinks
from alphaloom.streaming.metrics import drain_batches


def scored(figures: DataFrame) -> DataFrame:
    """Ratios, and the mean of completeness, anomaly and consistency scores; no rows score full."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    held = lambda ratio: F.greatest(F.lit(0.0), F.lit(100.0) - F.col(ratio) * 100)
    out = figures.withColumns({"null_ratio": share("nulls", "cells"), "anomaly_ratio": share("anomalies", "rows"), "dates_unique": F.col("duplicates") == 0})
    consistency = F.when(F.col("dates_unique"), 100.0).otherwise(50.0)
    return out.withColumn("overall_score", (held("null_ratio") + held("anomaly_ratio") + consistency) / 3)


def _key(keys: list[str]) -> Column:
    """Null parts count as values: a struct is equal to another of equal parts."""
    return F.struct(*keys).alias("key")


def batch_figures(batch: DataFrame, numeric: list[str], keys: list[str], seen: DataFrame | None = None) -> DataFrame:
    """One row of figures that add up over batches: rows, null cells, cells, anomalies, duplicates, and of each number its count, sum and sum of squares.

    A row is a duplicate if its key was there before, in this batch or in ``seen`` (column key).
    Anomalies are judged within the batch, by robust z scores.
    """
    nulls = sum((F.col(c).isNull().cast("long") for c in batch.columns[1:]), F.col(batch.columns[0]).isNull().cast("long"))
    moments = [a for c in numeric for a in (F.count(c).alias(f"count_{c}"), F.sum(F.col(c).cast("double")).alias(f"sum_{c}"), F.sum(F.col(c).cast("double") * F.col(c)).alias(f"square_{c}"))]
    cells = (F.count("*") * len(batch.columns)).alias("cells")
    base = robust_anomalies(batch.withColumn("_nulls", nulls), numeric).agg(F.count("*").alias("rows"), F.sum("_nulls").alias("nulls"), cells, F.count_if("is_anomaly").alias("anomalies"), *moments)
    counted = batch.groupBy(_key(keys)).agg(F.count("*").alias("n"))
    if seen is None:
        first = counted.withColumn("first", F.lit(1))
    else:
        known = seen.select("key").distinct().withColumn("known", F.lit(True))
        first = counted.join(known, counted["key"].eqNullSafe(known["key"]), "left").select("n", F.col("known").isNull().cast("int").alias("first"))
    again = first.agg(F.coalesce(F.sum(F.col("n") - F.col("first")), F.lit(0)).alias("duplicates"))
    return base.crossJoin(F.broadcast(again))  # one row each


def check_batches(rows: DataFrame, numeric: list[str], path: str, keys: tuple[str, ...] = ("ts_code", "trade_date"), day: str = "trade_date") -> None:
    """Check every micro-batch: a row of figures an epoch in ``path``, and its new keys by month in ``path_keys``.

    Keys of earlier batches are read for the months of a batch only. A repeated epoch writes the
    same folders again; it doesn't see its own keys.
    """
    keys = list(keys)

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        month = F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none"))
        seen = None
        if epoch > 0 and sinks.path_exists(spark, f"{path}_keys"):
            months = [r[0] for r in batch.select(month).distinct().collect()]  # one text for each month
            seen = spark.read.parquet(f"{path}_keys").where((F.col("epoch") < epoch) & F.col("month").isin(months))
        batch_figures(batch, numeric, keys, seen).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        fresh = batch.select(_key(keys), month.alias("month")).distinct()
        if seen is not None:
            old = seen.select("key").distinct()
            fresh = fresh.join(old, fresh["key"].eqNullSafe(old["key"]), "left_anti")
        fresh.write.mode("overwrite").partitionBy("month").parquet(f"{path}_keys/epoch={epoch}")

    drain_batches(rows, each)


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """Figures and scores of each batch."""
    return scored(spark.read.parquet(path))


def running_result(spark: SparkSession, path: str) -> DataFrame:
    """Figures over all batches, each weighted by its rows, one row."""
    every = spark.read.parquet(path)
    sums = [c for c in every.columns if c != "epoch"]
    total = scored(every.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), F.count("*").alias("batches")))
    for c in [c[6:] for c in sums if c.startswith("count_")]:
        n, s, q = F.col(f"count_{c}"), F.col(f"sum_{c}"), F.col(f"square_{c}")
        total = total.withColumns({f"mean_{c}": F.try_divide(s, n), f"std_{c}": F.sqrt(F.greatest(F.lit(0.0), F.try_divide(q, n) - F.pow(F.try_divide(s, n), 2)))})
    return total
