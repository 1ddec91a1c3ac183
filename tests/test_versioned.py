"""Upserts as deltas: merge on read, pruning, cut-off changes, compaction."""

import pytest
from pyspark.sql import functions as F

from alphaloom.sources.versioned import VersionedTable

SCHEMA = "code string, day int, month string, v double, note string"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), ["code", "day", "month"], "month")


def rows(spark, *data):
    return spark.createDataFrame([(c, d, f"m{d // 10}", v, n) for c, d, v, n in data], SCHEMA)


def content(df):
    return sorted((r.code or "", r.day, r.v, r.note) for r in df.collect())


def test_newest_change_of_a_key_counts(spark, table):
    table.upsert(rows(spark, ("a", 1, 1.0, "x"), ("b", 1, 2.0, "x"), ("a", 11, 3.0, "x"), (None, 1, 4.0, "x")))
    table.upsert(rows(spark, ("a", 1, 10.0, "y"), ("c", 1, 5.0, "y"), (None, 1, 6.0, "y")))
    table.upsert(rows(spark, ("a", 1, 20.0, "z")))
    assert content(table.read()) == [("", 1, 6.0, "y"), ("a", 1, 20.0, "z"), ("a", 11, 3.0, "x"), ("b", 1, 2.0, "x"), ("c", 1, 5.0, "y")]
    assert content(table.read(version=1)) == [("", 1, 4.0, "x"), ("a", 1, 1.0, "x"), ("a", 11, 3.0, "x"), ("b", 1, 2.0, "x")]


def test_only_changed_rows_are_written_and_only_their_months(spark, table, tmp_path):
    table.upsert(rows(spark, *[("a", d, 1.0, "x") for d in range(40)]))
    table.upsert(rows(spark, ("a", 5, 2.0, "y")))
    delta = spark.read.parquet(str(tmp_path / "t/data/stored_change=2"))
    assert delta.count() == 1 and delta.select("month").distinct().count() == 1
    plan = table.read().where("month = 'm3'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert len(table.read(partitions=["m3"]).inputFiles()) < len(table.read().inputFiles())


def test_given_columns_change(spark, table):
    table.upsert(rows(spark, ("a", 1, 1.0, "x"), ("b", 1, 2.0, "x")))
    table.upsert(rows(spark, ("a", 1, 10.0, "lost"), ("c", 1, 3.0, "new")), update=["v"])
    table.upsert(rows(spark, ("b", 1, 7.0, "y")).drop("note"))
    assert content(table.read()) == [("a", 1, 10.0, "x"), ("b", 1, 7.0, "x"), ("c", 1, 3.0, "new")]
    assert table.read().where("updated_at IS NULL").count() == 0


def test_a_cut_off_change_leaves_the_table(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", 1, 1.0, "x"), ("b", 11, 2.0, "x")))
    before = content(table.read())

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(table, "_commit", killed)  # rows are there, the manifest isn't
        with pytest.raises(KeyboardInterrupt):
            table.upsert(rows(spark, ("a", 1, 9.0, "y"), ("z", 1, 9.0, "y")))
    assert content(table.read()) == before
    failing = rows(spark, ("a", 1, 9.0, "y")).withColumn("v", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(failing)
    assert content(table.read()) == before
    table.upsert(rows(spark, ("a", 1, 5.0, "z")))
    assert content(table.read()) == [("a", 1, 5.0, "z"), ("b", 11, 2.0, "x")]


def test_two_writers_of_one_number(spark, table):
    table.upsert(rows(spark, ("a", 1, 1.0, "x")))
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(1, [], rows(spark).schema)


def test_units_are_replaced_whole(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "days"), ["day", "month"], "month")
    table.write(rows(spark, ("a", 1, 1.0, "x"), ("b", 1, 2.0, "x"), ("a", 2, 3.0, "x")))
    table.write(rows(spark, ("a", 1, 9.0, "y")))
    assert content(table.read()) == [("a", 1, 9.0, "y"), ("a", 2, 3.0, "x")]


def test_compaction_and_expiry(spark, table):
    for k in range(4):
        table.upsert(rows(spark, ("a", 1, float(k), "x"), (f"c{k}", 11 if k else 25, 1.0, "x")))
    before, files = content(table.read()), len(table.read().inputFiles())
    assert table.compact() == ["m0", "m1"] and table.compact() == []
    assert content(table.read()) == before and len(table.read().inputFiles()) < files
    assert table.expire() == 7 and content(table.read()) == before and table.versions() == [5]
    table.upsert(rows(spark, ("a", 1, 99.0, "x")))
    assert ("a", 1, 99.0, "x") in content(table.read())


def test_no_table(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    with pytest.raises(ValueError):
        VersionedTable(spark, "x", ["a"], "month")
