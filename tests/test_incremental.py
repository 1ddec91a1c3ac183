"""Incremental reads: folders that a scan opens, tables that sessions share."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import incremental as I
from alphaloom.sources import tables


def scanned_files(df):
    """Files that the scan of a collected plan read."""
    df.collect()
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec" and "month" in node.relation().partitionSchema().simpleString():
            found.append(int(node.metrics().apply("numPartitions").value()))
        children = node.children()
        for k in range(children.length()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_one_day_reads_only_its_months(spark, folder):
    months = tables.monthly(spark, folder)
    every = months.select("month").distinct().count()
    day = months.agg(F.max("trade_date")).first()[0]
    missing = months.where(F.col("trade_date") == F.lit(day)).select("ts_code", F.lit("sma_5").alias("factor_name"), "trade_date")
    found = I.lookback_scan(months, missing, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = scanned_files(found)
    assert every > 60 and min(read) <= 3
    bounds = found.agg(F.min("trade_date"), F.max("trade_date")).first()
    assert bounds[0] >= day - dt.timedelta(days=30) and bounds[1] == day


def test_pruned_scan_is_the_whole_scan(spark, folder):
    months = tables.monthly(spark, folder)
    missing = months.where("trade_date BETWEEN DATE '1999-03-10' AND DATE '1999-04-02' AND ts_code % 3 = 0").select("ts_code", "trade_date", F.lit("x").alias("factor_name"))
    pruned, plain = I.lookback_scan(months, missing, 40), I.lookback_scan(months.drop("month"), missing, 40)
    assert pruned.count() > 50 and pruned.exceptAll(plain).count() == plain.exceptAll(pruned).count() == 0
    assert I.lookback_scan(months, missing.limit(0), 40).count() == 0


def test_scan_goes_on_after_the_last_missing_day(spark, folder):
    months = tables.monthly(spark, folder)
    missing = months.where("trade_date = DATE '1999-03-10'").select("ts_code", "trade_date", F.lit("x").alias("factor_name"))
    codes = [r[0] for r in missing.select("ts_code").distinct().collect()]
    wanted = months.where(F.col("ts_code").isin(codes) & (F.col("trade_date") >= F.date_sub(F.lit("1999-03-10").cast("date"), 30)))
    assert codes and wanted.agg(F.max("trade_date")).first()[0] > dt.date(1999, 4, 30)
    for bars in (months, months.drop("month")):
        assert I.lookback_scan(bars, missing, 20).count() == wanted.count()


def test_stored_tables_are_kept_for_later_sessions(spark, folder):
    path = tables._kept(spark, folder, "bars-8", tables.build_bars, lambda p: tables.build_bars(spark, folder).write.parquet(p))
    other = spark.newSession()
    before = os.path.getmtime(path)
    assert tables.bars(other, folder).count() == tables.bars(spark, folder).count()
    assert os.path.getmtime(path) == before
    again = tables._kept(other, folder, "bars-8", tables.build_bars, lambda p: pytest.fail("written twice"))
    assert again == path


def test_fingerprint_follows_files_and_code(spark, tmp_path, folder):
    for t in tables.BASE_TABLES:
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    first = tables.fingerprint(spark, str(tmp_path), tables.build_bars)
    assert first == tables.fingerprint(spark, str(tmp_path), tables.build_bars) != tables.fingerprint(spark, str(tmp_path), tables.build_statements)
    spark.read.parquet(f"{folder}/region.parquet").write.mode("append").parquet(f"{tmp_path}/region.parquet")
    assert tables.fingerprint(spark, str(tmp_path), tables.build_bars) != first


def test_old_tables_go(spark, folder, tmp_path):
    tables.bars(spark, folder)
    assert tables.expire(spark, 1) == 0
    assert tables.bars(spark, folder).count() > 0


def test_buckets_follow_the_trades(spark, folder, monkeypatch):
    """A task's bucket stays of one size: eight buckets held anything up to 1 GB."""
    for mb, buckets in ((1, 8), (645, 80), (3870, 483)):
        monkeypatch.setattr(tables, "estimated_bytes", lambda df, mb=mb: mb * 1024 * 1024)
        assert tables.bucket_count(spark, folder) == buckets
