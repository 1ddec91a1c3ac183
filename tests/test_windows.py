"""Windows of a stream in many files out of order: windows and late rows hold every row."""

import random
import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from alphaloom.streaming import windows as W

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "name string, ts timestamp, value double"


def files(spark, folder, rng, count=5, rows=120):
    """Files whose times advance by half an hour each, with rows up to an hour behind; returns rows by file."""
    out = []
    for k in range(count):
        part = [(rng.choice("aab"), START + timedelta(seconds=1800 * k + rng.randint(0, 1800) - (rng.randint(0, 3600) if rng.random() < 0.3 else 0)), rng.choice([rng.random(), None])) for _ in range(rows)]
        out.append(part)
        spark.createDataFrame(part + [("a", None, 1.0)], SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")
    return out


def plain(parts, width, slide, delay):
    """(closed windows, late pairs) by the same rules, row by row."""
    open_, closed, late, mark = {}, {}, 0, None
    for part in parts:
        for name, ts, value in part:
            begin = START + timedelta(seconds=(ts - START).total_seconds() // slide * slide)
            while begin + timedelta(seconds=width) > ts:
                end = begin + timedelta(seconds=width)
                if mark is not None and end <= mark:
                    late += 1
                else:
                    open_.setdefault((begin, end, name), []).append((ts, value))
                begin -= timedelta(seconds=slide)
        mark = max(filter(None, [mark, max(ts for _, ts, _ in part) - timedelta(seconds=delay)]))
        for key in [k for k in open_ if k[1] <= mark]:
            closed[key] = open_.pop(key)
    return closed, open_, late


@pytest.mark.parametrize("width,slide", [(600, 600), (1200, 300)])
def test_windows_and_late_rows_hold_every_row(spark, tmp_path, width, slide):
    parts = files(spark, f"{tmp_path}/in", random.Random(width))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    path = f"{tmp_path}/out"
    found = W.closed_windows(stream, path, W.value_figures(), f"{width} seconds", f"{slide} seconds" if slide != width else None, "5 minutes")
    closed, open_, late = plain(parts, width, slide, 300)
    got = {(r.window_start.replace(tzinfo=timezone.utc), r.window_end.replace(tzinfo=timezone.utc), r["name"]): r for r in found.collect()}
    assert got.keys() == closed.keys() and len(got) > 10 and late > 20
    for key, rows in closed.items():
        values, r = [v for _, v in rows if v is not None], got[key]
        assert r["count"] == len(values)
        if values:
            assert (r["min"], r["max"]) == (min(values), max(values))
            assert r["mean"] == pytest.approx(statistics.fmean(values)) and r["std"] == pytest.approx(statistics.pstdev(values), abs=1e-12)
            assert r["median"] == statistics.median_low(values)
            assert r["latest"] == max((t, v) for t, v in rows if v is not None)[1]
    lost = W.late_rows(spark, path)
    assert lost.where("window_end IS NOT NULL").count() == late and lost.where("ts IS NULL").count() == len(parts)
    per_row = width // slide
    last = spark.read.parquet(f"{path}_batches").agg(F.max("epoch")).first()[0]
    still = spark.read.parquet(f"{path}/epoch={last}").where("open = 'true'")
    assert sum(len(r) for r in closed.values()) + sum(len(r) for r in open_.values()) + late == per_row * sum(map(len, parts))
    assert found.agg(F.sum("count")).first()[0] + still.agg(F.sum("n")).first()[0] + lost.where("window_end IS NOT NULL AND value IS NOT NULL").count() == per_row * sum(v is not None for p in parts for _, _, v in p)
    told = W.batch_counts(spark, path).agg(F.sum("rows"), F.sum("late")).first()
    assert tuple(told) == (per_row * sum(map(len, parts)), late)
    assert W.late_counts(spark, path).agg(F.sum("late")).first()[0] == late + len(parts)


def test_repeated_epoch_changes_nothing(spark, tmp_path):
    """The state before an epoch decides, so running the stream again from the start gives the same files."""
    files(spark, f"{tmp_path}/in", random.Random(1), 3, 40)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    first = sorted(map(str, W.closed_windows(stream(), f"{tmp_path}/out", W.value_figures(), "10 minutes").collect()))
    again = sorted(map(str, W.closed_windows(stream(), f"{tmp_path}/out", W.value_figures(), "10 minutes").collect()))
    assert first == again and first


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    assert W.closed_windows(stream, f"{tmp_path}/out", W.value_figures(), "10 minutes").count() == 0


def test_requests(spark, tmp_path):
    rows = [(START + timedelta(seconds=10 * k), float(k), k % 4 > 0, k % 2 == 0) for k in range(400)]
    for k in range(2):
        spark.createDataFrame(rows[200 * k : 200 * (k + 1)], "ts timestamp, value double, ok boolean, cached boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("ts timestamp, value double, ok boolean, cached boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = W.closed_windows(stream, f"{tmp_path}/out", W.request_figures(), "10 minutes").orderBy("window_start").collect()
    assert [(r.requests, r.success_rate, r.cache_hit_rate, r.avg_time) for r in found[:2]] == [(60, 0.75, 0.5, 29.5), (60, 0.75, 0.5, 89.5)]
