"""Every registered query of the engine against its SQL on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
import oracle
from alphaloom.catalog import ORACLES as SQL
from alphaloom.catalog import QUERIES

COARSE = {"factor_statistics"}  # rounded to three places
LARGER = {"factor_rating", "factor_ranking", "information_coefficient_p_values"}  # ten securities a day are too few


@pytest.fixture(scope="module")
def duck(folder):
    return oracle.connect(folder)


def is_number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, duck):
    if name in LARGER:
        folder = "/root/testdata/sf0.01"
        duck = oracle.connect(folder)
    df = QUERIES[name](spark, folder)
    if name in SQL:
        assert oracle.compare(df, duck, SQL[name], tol=2e-3 if name in COARSE else 2e-5) == []
        return
    # No SQL: there are rows, none twice, and every column of numbers says something.
    rows = df.collect()
    assert rows and len({tuple(map(str, r)) for r in rows}) == len(rows)
    for name, kind in df.dtypes:
        if kind in ("double", "bigint", "int"):
            assert any(is_number(r[name]) for r in rows), name


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
