"""Checks across batches, and tasks that leave the state."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from alphaloom.streaming import checks, tasks

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
BAR = "ts_code string, trade_date date, close double, vol double"
UPDATE = "task_id string, ts timestamp, status string, progress double, records long"


def stream_of(spark, folder, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def bar(code, day, close, vol=1.0):
    return (code, (START + timedelta(days=day)).date() if day is not None else None, close, vol)


def test_duplicates_over_batches_and_running_figures(spark, tmp_path):
    first = [bar("a", d, 10.0 + d % 3) for d in range(50)] + [bar("b", 0, None)]
    second = [bar("a", d, 10.0 + d % 3) for d in range(48, 80)] + [bar("b", 1, 5000.0), bar("c", None, 11.0), bar("c", None, 11.0)]
    third = [bar("c", None, 12.0)]
    path = f"{tmp_path}/out"
    checks.check_batches(stream_of(spark, f"{tmp_path}/in", [first, second, third], BAR), ["close"], path)
    batches = {r.epoch: r for r in checks.batch_results(spark, path).collect()}
    # a's days 48 and 49 came before; c has no day twice in the second batch and again in the third.
    assert [batches[k].duplicates for k in range(3)] == [0, 3, 1]
    assert [batches[k]["rows"] for k in range(3)] == [51, 35, 1] and [batches[k].nulls for k in range(3)] == [1, 2, 1]
    assert batches[1].anomalies == 1 and batches[0].dates_unique and not batches[1].dates_unique
    total = checks.running_result(spark, path).first()
    rows = first + second + third
    values = [r[2] for r in rows if r[2] is not None]
    assert (total["rows"], total.duplicates, total.batches) == (87, 4, 3)
    assert total.null_ratio == pytest.approx(4 / (87 * 4)) and total.anomaly_ratio == pytest.approx(1 / 87)
    assert total.overall_score == pytest.approx((100 - 100 * total.null_ratio + 100 - 100 / 87 + 50) / 3)
    mean = sum(values) / len(values)
    assert total.mean_close == pytest.approx(mean) and total.std_close == pytest.approx((sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5)


def test_keys_are_read_of_the_months_of_a_batch(spark, tmp_path):
    path = f"{tmp_path}/out"
    checks.check_batches(stream_of(spark, f"{tmp_path}/in", [[bar("a", d, 1.0) for d in range(0, 120, 10)], [bar("a", 100, 1.0)]], BAR), ["close"], path)
    assert sum(r.duplicates for r in checks.batch_results(spark, path).collect()) == 1
    keys = spark.read.parquet(f"{path}_keys")
    assert keys.count() == 12 and keys.select("month").distinct().count() == 4


def updates(spark, tmp_path, parts):
    rows = [[(t, START + timedelta(minutes=m), s, p, n) for t, m, s, p, n in part] for part in parts]
    return stream_of(spark, f"{tmp_path}/in", rows, UPDATE).withWatermark("ts", "10 minutes")


def test_finished_tasks_leave_the_state(spark, tmp_path):
    """Twenty tasks begin, most end, one starts again, one falls silent."""
    begin = [(f"t{k}", k, "running", 1.0, 10) for k in range(20)]
    more = [(f"t{k}", 30 + k, "completed" if k % 2 else "failed", 150.0, 100 * k) for k in range(16)] + [("t16", 40, "running", 50.0, 5), ("t16", 45, "running", 60.0, 6)]
    last = [("t0", 60, "running", 2.0, 1), ("t17", 60, "running", 3.0, None), ("t19", 300, "running", 9.0, 1), (None, 300, "running", 1.0, 1)]
    path = f"{tmp_path}/out"
    query = tasks.follow_tasks(updates(spark, tmp_path, [begin, more, last]), path, "3 hours")
    found = {r.task_id: r for r in tasks.results(spark, path).collect()}
    assert len(found) == 20 and {found[f"t{k}"].status for k in range(1, 16, 2)} == {"completed"}
    assert found["t3"].progress == 100.0 and found["t3"].records == 300 and found["t3"].updates == 2
    assert found["t16"].status == "expired" and found["t16"].progress == 60.0 and found["t16"].updates == 3
    assert found["t0"].status == "expired" and found["t0"].updates == 1  # started anew after it had failed
    assert found["t19"].status == "running"
    live = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(live) == 20 and live[-1] == 1


def test_changes_are_written_and_folders_follow_the_tasks(spark, tmp_path):
    parts = [[(f"t{k}", b, "running", float(b), 1) for k in range(40 * b, 40 * b + 45)] for b in range(4)]
    path = f"{tmp_path}/out"
    tasks.follow_tasks(updates(spark, tmp_path, parts), path, "100 days", compact_every=2, slice_tasks=20)
    own = tasks.table(spark, path)
    assert own.read().count() == 165 and own.read().select("task_id").distinct().count() == 165
    assert tasks.slices_of(own) >= 8 and own.read().groupBy("slice").count().agg(F.max("count")).first()[0] <= 40
    assert len(own.versions()) <= 3
