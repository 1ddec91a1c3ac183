"""Pages by offset index against a sorted list, and what they open."""

import pytest
from pyspark.sql import functions as F

from alphaloom.sources.pages import Pages


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 7).alias("g")).repartition(6)
    return Pages(df, [F.desc("g"), F.asc("k")], f"{tmp_path_factory.mktemp('p')}/t", part_rows=400)


def test_pages_are_slices(pages):
    rows = sorted(((k * 7919 % 5000, k % 7) for k in range(5000)), key=lambda r: (-r[1], r[0]))
    for number, size in ((1, 30), (3, 40), (100, 50), (7, 777), (1, 5000)):
        got = sorted(pages.page(number, size).collect(), key=lambda r: r.row_number)
        assert [(r.k, r.g) for r in got] == rows[(number - 1) * size : number * size]
        assert [r.row_number for r in got] == list(range((number - 1) * size + 1, min(number * size, 5000) + 1))
        assert {(r.total, r.page, r.pages, r.has_next, r.has_prev) for r in got} == {(5000, number, -(-5000 // size), number * size < 5000, number > 1)}
    assert pages.page(101, 50).count() == 0
    with pytest.raises(ValueError):
        pages.page(0, 10)


def test_a_late_page_opens_as_few_parts_as_an_early_one(pages):
    assert len(pages.index) >= 10 and max(n for _, _, n in pages.index) < 1500
    assert all(len(pages.parts_of(k, 10)) <= 2 for k in range(1, 501))
    plan = pages.page(400, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_part" in plan.split("PartitionFilters")[1].split("]")[0]
    assert 1 <= len(pages.parts_of(500, 10)) <= 2 and 1 <= len(pages.parts_of(3, 10)) <= 2


def test_empty_table(spark, tmp_path):
    empty = Pages(spark.createDataFrame([], "k long"), [F.asc("k")], f"{tmp_path}/t")
    assert empty.total == 0 and empty.page(1, 10).count() == 0
