"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("alphaloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and derived tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without the setting
    gets a temporary folder; on a cluster a missing setting is an error, because a folder on
    one machine is not visible to the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="alphaloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark).rstrip('/')}/{app}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table under the shared folder and go on from its files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Exchanged rows of queries that are planned inside leave the disk when their query ends.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored_in_turns(spark: SparkSession, parts: Iterable[DataFrame], label: str) -> DataFrame:
    """Write one or more parts of a table, each planned when the one before is written, and go on from their files.

    The disk holds the exchanged rows of one part at a time.
    """
    path = scratch_path(spark, label)
    with brief_shuffles(spark):
        for part in parts:
            part.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the checkpoint folder and go on from the files.

    Used on small results that several later steps read, so that none of them repeats the work
    before, and the loss of an executor costs no more than a read.
    """
    scratch_root(df.sparkSession)
    return df.checkpoint()
