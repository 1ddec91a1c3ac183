"""Writers: exports, append, idempotent replacement, archive and retention. Upserts are in ``versioned``.

Stored tables are Parquet folders partitioned by one or more columns. Replacement works on whole
partitions through dynamic partition overwrite, which stages the new files before it removes the
old ones; on plain Parquet it is not atomic across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("csv", "json", "parquet")


def export(df: DataFrame, path: str, fmt: str, mode: str = "overwrite", **options) -> str:
    """Write a table in an allowed format; an unknown format is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown export format {fmt}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.format(fmt).save(path)
    return path


def read_export(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def verify_export(spark: SparkSession, path: str, fmt: str, schema: StructType, expected: int) -> bool:
    """Read an export back and compare its row count."""
    return read_export(spark, path, fmt, schema).count() == expected


def stamped(df: DataFrame, column: str = "updated_at") -> DataFrame:
    return df.withColumn(column, F.current_timestamp())


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace exactly the partitions that occur in ``df``; saving again changes nothing."""
    # Rebalancing gives each folder few files and lets AQE split a folder that is too large for one task.
    (
        df.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def drop_partitions(spark: SparkSession, path: str, column: str, values: list) -> int:
    """Remove whole partition folders; returns how many existed."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    removed = 0
    for v in values:
        folder = fs_path(f"{path}/{column}={v}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        removed += bool(fs.exists(folder) and fs.delete(folder, True))
    return removed


def partition_values(spark: SparkSession, path: str, column: str) -> list:
    """Values of a partition column, read from folder names; one per stored period."""
    return sorted(r[0] for r in spark.read.parquet(path).select(column).distinct().collect())


def month_of(date: str = "trade_date") -> Column:
    return F.date_format(date, "yyyy-MM")


def archive(spark: SparkSession, path: str, target: str, before_month: str, codec: str = "zstd", column: str = "month") -> DataFrame:
    """Copy months before the cutoff to a compressed archive, then drop them from the table.

    The copy is one distributed job. Partitions are dropped only after the archive holds as many
    rows as were read. Returns the rows archived per month.
    """
    old = spark.read.parquet(path).where(F.col(column) < before_month)
    counts = old.groupBy(column).agg(F.count("*").alias("rows"))
    old.write.mode("overwrite").option("compression", codec).option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(target)
    log = counts.collect()  # one row per month
    stored = {r[column]: r["rows"] for r in spark.read.parquet(target).groupBy(column).agg(F.count("*").alias("rows")).collect()}
    if any(stored.get(r[column]) != r["rows"] for r in log):
        raise RuntimeError("archive is incomplete, nothing was dropped")
    drop_partitions(spark, path, column, [r[column] for r in log])
    return spark.createDataFrame([(r[column], r["rows"]) for r in log], f"{column} string, rows long")


def restore(spark: SparkSession, archive_path: str, path: str, months: list[str], column: str = "month") -> None:
    """Put archived months back into the table."""
    rows = spark.read.parquet(archive_path).where(F.col(column).isin(months))
    replace_partitions(rows, path, [column])


def apply_retention(spark: SparkSession, path: str, before_month: str, column: str = "month") -> int:
    return drop_partitions(spark, path, column, [v for v in partition_values(spark, path, column) if v < before_month])


def backup(spark: SparkSession, path: str, target: str, codes: list | None, factors: list[str], start, end) -> DataFrame:
    """Snapshot of the rows a recalculation is about to replace."""
    rows = spark.read.parquet(path).where(F.col("factor_name").isin(factors) & F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if codes is not None:
        rows = rows.where(F.col("ts_code").isin(codes))
    rows.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
