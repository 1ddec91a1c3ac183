"""Running bucket statistics over several batches."""

import pytest

from alphaloom.operators.preprocess import update_quantiles

SCHEMA = "factor_name string, quantile int, count long, min_value double, max_value double, mean_value double, std_value double"
KEYS = ("factor_name", "quantile")


def table(spark, *rows):
    return spark.createDataFrame([(f, q, n, v - 1, v + 1, v, 0.5) for f, q, n, v in rows], SCHEMA)


def test_absent_buckets_keep_their_state(spark):
    state = table(spark, ("a", 1, 5, 10.0), ("b", 1, 7, 20.0))
    state = update_quantiles(table(spark, ("a", 1, 6, 20.0), ("c", 2, 2, 3.0)), state, KEYS, 0.9, keep=True)
    state = update_quantiles(table(spark, ("a", 1, 8, 0.0)), state, KEYS, 0.9, keep=True)
    found = {(r.factor_name, r.quantile): (r["count"], r.mean_value, r.min_value) for r in state.collect()}
    assert found.keys() == {("a", 1), ("b", 1), ("c", 2)}
    assert found[("b", 1)] == (7, 20.0, 19.0) and found[("c", 2)] == (2, 3.0, 2.0)
    mean = (10.0 * 0.9 + 20.0 * 0.1) * 0.9
    assert found[("a", 1)] == (8, pytest.approx(mean), pytest.approx(mean - 0.9 - 0.1))


def test_plain_update_returns_current_buckets_only(spark):
    found = update_quantiles(table(spark, ("a", 1, 6, 20.0)), table(spark, ("b", 1, 7, 20.0)), KEYS)
    assert [(r.factor_name, r.mean_value) for r in found.collect()] == [("a", 20.0)]
