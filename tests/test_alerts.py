"""Alert rules cut into blocks and batches against the rule's own state machine."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from alphaloom.streaming import alerts as A
from alphaloom.streaming import metrics as S

POINT = "rule_id string, at long, value double, hit boolean, need int, wait long"


def plain(points, state):
    """Alerts and state after the points, one after the other."""
    out = []
    for rule, at, value, hit, need, wait in sorted(points, key=lambda p: (p[0], p[1], p[2])):
        hits, last = state.get(rule, (0, A.NEVER))
        hits = hits + 1 if hit else 0
        if hit and hits >= need and (last == A.NEVER or at - last >= wait):
            out.append((rule, at, value, hits))
            hits, last = 0, at
        state[rule] = (hits, last)
    return sorted(out)


def batch(rng, clock, size):
    """Points of six rules; the first holds a third of them. Values tell equal times apart."""
    rules = [("hot", 3, 40), ("each", 1, 0), ("rare", 6, 5), ("slow", 1, 900), ("pair", 2, 0), ("never", 50, 0)]
    out = []
    for _ in range(size):
        rule, need, wait = rules[0] if rng.random() < 1 / 3 else rng.choice(rules[1:])
        clock[0] += rng.choice([0, 0, 1, 2, 5, 60 if rng.random() < 0.02 else 1])
        out.append((rule, clock[0], rng.random(), rng.random() < (0.95 if rule in ("hot", "slow") else 0.7), need, wait))
    return out


@pytest.mark.parametrize("block", [10, 37, 100_000])
def test_batches_in_blocks(spark, block):
    rng, clock, expected, found_state = random.Random(block), [1000], {}, None
    for size in (400, 3, 300):
        points = batch(rng, clock, size)
        found, found_state = A.fire(spark.createDataFrame(points, POINT), found_state, block)
        found_state = A.stored(found_state, "test-state")
        got = sorted((r.rule_id, r["at"], r.value, r.hits) for r in found.collect())
        assert got == plain(points, expected)
        assert {r.rule_id: (r.hits, r.last) for r in found_state.collect()} == expected


def test_all_points_hit_in_one_rule(spark):
    """Chains that never meet: every place has its own successor."""
    points = [("r", 3 * k, float(k), True, 1, 10) for k in range(500)]
    found, state = A.fire(spark.createDataFrame(points, POINT), None, 20)
    assert sorted(r["at"] for r in found.collect()) == [p[1] for p in points[::4]]
    assert state.first().asDict() == {"rule_id": "r", "hits": 3, "last": 1488}


def test_no_block_holds_a_rule(spark):
    """Work is dealt by block, so a rule with all points is many groups."""
    points = spark.createDataFrame([("r", k, float(k), k % 5 > 0, 2, 0) for k in range(2000)], POINT)
    rows = A.stored(points.repartitionByRange(20, "rule_id", "at", "value").withColumn("part", A.F.spark_partition_id()), "test-blocks")
    assert rows.groupBy("part").count().agg(A.F.max("count")).first()[0] < 250
    found, _ = A.fire(points, None, 100)
    assert found.count() == 800


def test_streams_over_several_files(spark, tmp_path):
    rng, clock = random.Random(3), [0]
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rules = spark.createDataFrame([("a", "m", 0.5, ">", 2, 30.5, True), ("b", "m", 0.2, "<=", 1, 0.0, True), ("off", "m", 0.0, ">", 1, 0.0, False)], "rule_id string, metric string, threshold double, comparison string, trigger_count int, evaluation_window double, enabled boolean")
    schema = "name string, ts timestamp, value double"
    expected, state = [], {}
    for k in range(4):
        rows = []
        for _ in range(80):
            clock[0] += rng.randint(1, 20)
            rows.append(("m", start + timedelta(seconds=clock[0]), rng.random()))
        spark.createDataFrame(rows + [("other", start, 1.0), ("m", None, 1.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        points = [(r, int((t - start).total_seconds()) * 1_000_000, v, hit, need, wait) for _, t, v in rows for r, hit, need, wait in (("a", v > 0.5, 2, 30_500_000), ("b", v <= 0.2, 1, 0))]
        expected += plain(points, state)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = A.alerts(S.as_metrics(stream, "name", "ts", "value"), rules, f"{tmp_path}/out", block=25)
    zero = int(start.timestamp()) * 1_000_000
    got = sorted((r.rule_id, r["at"] - zero, r.value, r.hits) for r in found.withColumn("at", A.F.unix_micros("fired_at")).collect())
    assert got == sorted(expected) and spark.read.parquet(f"{tmp_path}/out").select("epoch").distinct().count() == 4
    titles = stream.select(A.F.col("name").alias("title"), A.F.col("ts").alias("fired_at"), "value")
    kept = sorted((r.fired_at for r in A.suppress(titles, 2.0, f"{tmp_path}/kept", block=25).where("title = 'm'").collect()))
    assert len(kept) > 5 and all((b - a).total_seconds() > 120 for a, b in zip(kept, kept[1:]))


def test_no_points(spark):
    found, state = A.fire(spark.createDataFrame([("r", None, 1.0, True, 1, 0), (None, 5, 1.0, True, 1, 0)], POINT))
    assert found.count() == state.count() == 0
    found, state = A.fire(spark.createDataFrame([], POINT), spark.createDataFrame([("r", 2, 7)], A.STATE))
    assert found.count() == 0 and [tuple(r) for r in state.collect()] == [("r", 2, 7)]
