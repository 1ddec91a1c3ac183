"""Readers for the base tables and the research panel built over them.

The panel is the set of views the operators work on: daily bars per security, the security
master with its industry, daily valuation figures, quarterly statements and the trading calendar.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.operators.crosssection import estimated_bytes
from alphaloom.session import brief_shuffles, scratch_root

CODE, DATE = "ts_code", "trade_date"
#: Tables that derived ones are built from.
BASE_TABLES = ("lineitem", "orders", "supplier", "nation", "region")

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bucket_count(spark: SparkSession, folder: str, target_bytes: int = 8 * 1024 * 1024) -> int:
    """Buckets of about ``target_bytes`` of trades each, by the optimizer's estimate.

    A task sorts its bucket several times, with every factor column, in rows many times as wide as
    the packed trades. The target is small, so that no sort of a task spills and its memory does
    not grow with the tables.

    All stored tables of a folder use the same number, so they join and derive without exchange.
    """
    return min(50_000, max(8, estimated_bytes(table(spark, folder, "lineitem")) // target_bytes))


def fingerprint(spark: SparkSession, folder: str, build) -> str:
    """A mark of the files behind a derived table and of what derives it.

    It changes when a base table's files change by name, size or time, and when the code does.
    """
    lines = [inspect.getsource(build)]
    for name in BASE_TABLES:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            lines.append(f"{name} {f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()[:16]


def _path(spark: SparkSession, name: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(name)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _kept(spark: SparkSession, folder: str, name: str, build, write) -> str:
    """The path of a derived table, written by ``write(path)`` unless an earlier session has done so.

    Tables lie in the shared folder by name and fingerprint. A table is written under another name
    and renamed when it is complete, so that no session sees part of it.
    """
    final = f"{scratch_root(spark).rstrip('/')}/tables/{name}-{fingerprint(spark, folder, build)}"
    fs, at = _path(spark, final)
    if not fs.exists(at):
        draft = f"{final}-{uuid.uuid4().hex[:8]}"
        write(draft)
        _, made = _path(spark, draft)
        if not fs.rename(made, at):  # another session was first
            fs.delete(made, True)
    return final


def _stored(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """Write a derived table once, bucketed by code, and read it back.

    Bucketing places every security's rows in one bucket, so the per-security windows that most
    factors use need no further exchange. Files sit in the shared folder, where later sessions find
    them, and survive the loss of an executor. ``build`` places its rows by code itself, before its
    own windows, so that the write finds every bucket in one task.
    """
    # Spark 4.1 takes a columnar union of bucketed scans as hash partitioned although it lines the
    # partitions up one after the other, which makes later groupings wrong. Unions exchange instead.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    buckets = bucket_count(spark, folder)
    order = "end_date" if name == "statements" else DATE

    def write(path: str) -> None:
        relation = "draft_" + uuid.uuid4().hex[:12]
        with brief_shuffles(spark):
            build(spark, folder).write.bucketBy(buckets, CODE).sortBy(CODE, order).option("path", path).format("parquet").saveAsTable(relation)
        spark.sql(f"DROP TABLE {relation}")  # its files lie at a path of their own and stay

    path = _kept(spark, folder, f"{name}-{buckets}", build, write)
    relation = "stored_" + re.sub("[^a-z0-9]", "_", path.rsplit("/", 1)[1])
    if not spark.catalog.tableExists(relation):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {relation} ({columns}) USING parquet CLUSTERED BY ({CODE}) SORTED BY ({CODE}, {order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(relation)


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    """The stored bars in folders by ``month``, for reads of few days: a filter or join on it prunes folders."""

    def write(path: str) -> None:
        rows = bars(spark, folder).withColumn("month", F.date_format(DATE, "yyyy-MM"))
        rows.hint("rebalance", "month").sortWithinPartitions("month", CODE, DATE).write.partitionBy("month").parquet(path)

    # Text even if all folders look like numbers.
    return spark.read.parquet(_kept(spark, folder, "months", build_bars, write)).withColumn("month", F.col("month").cast("string"))


def expire(spark: SparkSession, days: float = 30) -> int:
    """Remove derived tables that were written so many days ago; returns how many."""
    fs, at = _path(spark, f"{scratch_root(spark).rstrip('/')}/tables")
    removed = 0
    if fs.exists(at):
        for s in fs.listStatus(at):
            if s.getModificationTime() < (time.time() - days * 86_400) * 1000:
                removed += bool(fs.delete(s.getPath(), True))
    return removed


def by_code(frame: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    return frame.repartition(bucket_count(spark, folder), CODE)


def build_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars from single trades: the line items of one supplier on one ship date.

    The grouping combines on the map side, so a security with very many trades sends at most one
    row per day and task. First and last trade follow the primary key (order, line).
    """
    trades = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias(CODE),
        F.to_date("l_shipdate").alias(DATE),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("e"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )
    daily = trades.groupBy(CODE, DATE).agg(
        F.min_by("p", "seq").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "seq").alias("close"),
        F.sum("q").alias("vol"),
        F.sum("e").alias("amount"),
    )
    w = W.partitionBy(CODE).orderBy(DATE)
    return by_code(daily, spark, folder).withColumn("pre_close", F.lag("close").over(w))


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Stored daily bars; one row per (ts_code, trade_date)."""
    return _stored(spark, folder, "bars", build_bars)


def stock_basic(spark: SparkSession, folder: str) -> DataFrame:
    """Security master: industry is the region name, area the nation name."""
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("s_suppkey").alias(CODE),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("industry"),
            F.col("n_name").alias("area"),
            F.when(F.col("s_acctbal") < 0, "D").otherwise("L").alias("list_status"),
            F.col("s_acctbal").alias("acctbal"),
        )
    )


def daily_basic(spark: SparkSession, folder: str, frame: DataFrame | None = None) -> DataFrame:
    """Valuation figures per bar: running traded value stands in for market value."""
    frame = bars(spark, folder) if frame is None else frame
    upto = W.partitionBy(CODE).orderBy(DATE).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("amount").over(upto)
    return frame.select(
        "*",
        total.alias("total_mv"),
        (total * 0.6).alias("circ_mv"),
        (F.col("vol") * 100 / F.sum("vol").over(upto)).alias("turnover_rate"),
    )


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Trading days: at most one row per day of history."""
    days = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("cal_date")).distinct()
    return days.withColumn("is_open", F.lit(1))


def _status_sum(status: str) -> Column:
    return F.sum(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice")).otherwise(0.0))


def build_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly statements from orders.

    Customers are folded onto the listed securities; every figure is a linear form of the
    quarter's order value by status (finished, open, pending).
    """
    universe = table(spark, folder, "supplier").agg(F.count("*").alias("n_codes"))
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    quarter_end = F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2))
    base = (
        orders.crossJoin(F.broadcast(universe))  # one row
        .withColumn(CODE, F.col("o_custkey") % F.col("n_codes"))
        .groupBy(CODE, quarter_end.alias("end_date"))
        .agg(_status_sum("F").alias("f"), _status_sum("O").alias("o"), _status_sum("P").alias("p"))
    )
    f, o, p = F.col("f"), F.col("o"), F.col("p")
    return (
        by_code(base, spark, folder).select(
            CODE,
            "end_date",
            F.date_add("end_date", 30).alias("ann_date"),
            F.lit("1").alias("report_type"),
            (f + o + p).alias("revenue"),
            (f * 0.7 + o * 0.6 + p * 0.65).alias("oper_cost"),
            (f * 0.2 + o * 0.3 + p * 0.25).alias("operate_profit"),
            (f * 0.2 + o * 0.1 - p * 0.15).alias("net_profit"),
            ((f + o + p) * 3 + 500000.0).alias("total_assets"),
            ((f + o + p) * 1.2 + o * 0.4 + 100000.0).alias("total_liab"),
            ((f + o + p) * 1.1).alias("total_cur_assets"),
            (f * 0.8 + o * 0.5 + p * 0.3).alias("total_cur_liab"),
            F.when(o > 0, o * 0.2).alias("inventories"),
            (f * 0.25).alias("money_cap"),
            (f * 0.3 - p * 0.05).alias("operating_cash_flow"),
            (f * 0.28 + o * 0.38 + p * 0.33).alias("ebitda"),
        )
        .withColumn("total_hldr_eqy_exc_min_int", F.col("total_assets") - F.col("total_liab"))
        .withColumn("fin_exp", F.col("total_liab") * -0.02)
    )


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """Stored quarterly statements; one row per (ts_code, end_date)."""
    return _stored(spark, folder, "statements", build_statements)


def industry_members(spark: SparkSession, folder: str) -> DataFrame:
    """Dated industry membership: each security changes industry at a split day."""
    regions = table(spark, folder, "region")
    master = stock_basic(spark, folder).join(regions, F.col("industry") == F.col("r_name"), "left")
    split = F.lit("1998-06-01").cast("date")
    first = master.select(
        CODE, F.col("industry").alias("industry_name"), F.lit("1990-01-01").cast("date").alias("in_date"), split.alias("out_date")
    )
    later = regions.select(F.col("r_regionkey").alias("next_key"), F.col("r_name").alias("industry_name"))
    second = master.join(later, (F.col("r_regionkey") + 1) % 5 == F.col("next_key")).select(
        CODE, "industry_name", split.alias("in_date"), F.lit(None).cast("date").alias("out_date")
    )
    return first.unionByName(second)


def build_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Three factors per bar with industry, market value and one- and five-day returns."""
    from alphaloom.operators import technical as T

    frame = T.roc(T.volume_ratio(daily_basic(spark, folder), 5), 5)
    w = W.partitionBy(CODE).orderBy(DATE)

    def back(n):
        before = F.lag("close", n).over(w)
        return F.when(before > 0, F.col("close") / before - 1)

    frame = frame.select(
        CODE,
        DATE,
        "close",
        F.col("total_mv").alias("market_cap"),
        F.col("roc_5").alias("mom"),
        # Equal ratios must tie whatever the order of the sum behind them.
        F.round("volume_ratio_5", 8).alias("volr"),
        ((F.col("high") - F.col("low")) / F.col("close") * 100).alias("rng"),
        back(1).alias("return_1d"),
        back(5).alias("return_5d"),
    )
    return frame.join(stock_basic(spark, folder).select(CODE, "industry"), CODE, "left")


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Stored factor panel; one row per (ts_code, trade_date)."""
    return _stored(spark, folder, "panel", build_panel)
