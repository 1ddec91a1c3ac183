"""SQL-side functions and recursive queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.session import stored


def register(spark: SparkSession) -> None:
    """Make the SQL functions available to ``spark.sql`` in this session."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION calculate_return(start_price DOUBLE, end_price DOUBLE) RETURNS DOUBLE
           RETURN CASE WHEN start_price > 0 THEN (end_price - start_price) / start_price * 100 ELSE 0 END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION quality_status(score DOUBLE) RETURNS STRING
           RETURN CASE WHEN score >= 95 THEN 'PASS' WHEN score >= 80 THEN 'WARN' ELSE 'FAIL' END"""
    )


def first_to_last_return(spark: SparkSession, bars: DataFrame) -> DataFrame:
    register(spark)
    ends = bars.groupBy("ts_code").agg(F.min_by("close", "trade_date").alias("a"), F.max_by("close", "trade_date").alias("b"))
    return ends.select("ts_code", F.expr("calculate_return(a, b)").alias("gain"))


def _view(df: DataFrame, label: str) -> str:
    name = f"{label}_{uuid.uuid4().hex[:8]}"
    df.createOrReplaceTempView(name)
    return name


def dependency_closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Walk dependencies from tasks that depend on nothing; a path never visits a task twice.

    Paths are put together from stretches of doubling length: a path of ``length + r`` steps is one
    of ``r`` steps, found before, and a stretch of ``length`` steps. So the rounds grow with the
    logarithm of the depth, each is two joins on task ids, and each is written to the shared folder.
    A cycle ends where its stretches would meet themselves.
    """
    links = edges.select(F.col("depends_on").alias("start"), "task_id").where("start <> task_id").distinct()
    stretches = links.select("start", F.col("task_id").alias("stop"), F.array("task_id").alias("steps"))
    roots = nodes.join(edges.select("task_id").distinct(), "task_id", "left_anti")
    chain = roots.select("task_id", F.col("task_id").alias("root"), F.lit(0).alias("depth"), F.array("task_id").alias("path"))
    length = 1
    while True:
        stretches = stored(stretches, "stretches")
        if stretches.isEmpty():
            return chain
        longer = chain.join(stretches, F.col("task_id") == F.col("start")).where(~F.arrays_overlap("path", "steps"))
        longer = longer.select(F.col("stop").alias("task_id"), "root", (F.col("depth") + length).alias("depth"), F.concat("path", "steps").alias("path"))
        chain = stored(chain.unionByName(longer), "chain")
        ahead = stretches.select(F.col("start").alias("stop"), F.col("stop").alias("end"), F.col("steps").alias("more"))
        joined = stretches.join(ahead, "stop").where(~F.arrays_overlap("steps", "more") & ~F.array_contains("more", F.col("start")))
        stretches = joined.select("start", F.col("end").alias("stop"), F.concat("steps", "more").alias("steps"))
        length *= 2


def industry_paths(spark: SparkSession, upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Names along the classification levels, from parent links."""
    tree = upper.select(F.concat(F.lit("L1-"), "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit(-1).alias("nation_key"))
    tree = tree.unionByName(
        lower.select(F.concat(F.lit("L2-"), "n_nationkey").alias("code"), F.concat(F.lit("L1-"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation_key"))
    )
    v = _view(tree, "levels")
    return spark.sql(
        f"""WITH RECURSIVE walk(code, nation_key, region, nation, path) AS (
              SELECT code, nation_key, name, name, name FROM {v} WHERE parent IS NULL
              UNION ALL
              SELECT t.code, t.nation_key, w.region, t.name, concat(w.path, '/', t.name) FROM {v} t JOIN walk w ON t.parent = w.code)
            SELECT nation_key, region, nation, path FROM walk WHERE nation_key >= 0"""
    )
