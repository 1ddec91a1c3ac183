"""The split path gives the plain path's results; statistics match pandas and closed forms."""

import datetime as dt
import itertools
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alphaloom.functions import stats
from alphaloom.functions.scalars import inverse_normal
from alphaloom.operators import crosssection as X
from alphaloom.operators import effectiveness as E
from alphaloom.operators import ml
from alphaloom.operators import preprocess as P


@pytest.fixture
def split(monkeypatch):
    monkeypatch.setattr(X, "SMALL_INPUT_BYTES", 0)
    monkeypatch.setattr(X, "HOT_ROWS", 3)
    monkeypatch.setattr(X, "SPLITS", 7)


def skewed(spark, n=3000):
    """A third of the rows in one group, many ties, nulls and a group without values."""
    rng = np.random.default_rng(42)
    g = np.where(rng.random(n) < 0.35, "hot", rng.integers(0, 40, n).astype(str))
    x = np.round(rng.standard_t(2, n), 1)
    rows = [(i, k, None if rng.random() < 0.05 or k == "7" else float(v)) for i, (k, v) in enumerate(zip(g, x))]
    return spark.createDataFrame(rows, "id long, g string, x double"), pd.DataFrame(rows, columns=["id", "g", "x"])


def collect(df, *cols):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_split_positions_equal_plain(spark, split):
    df, pdf = skewed(spark)
    assert X.has_hot_group(df, "g")
    a = collect(X.with_positions(df, "g", "x", hot=False), "id", "_below", "_ties", "_n")
    b = collect(X.with_positions(df, "g", "x", hot=True), "id", "_below", "_ties", "_n")
    assert a == b
    rank = X.with_positions(df, "g", "x").select("id", X.average_rank().alias("r")).toPandas().set_index("id").r.sort_index()
    want = pdf.groupby("g").x.rank()
    assert np.allclose(rank, want.values, equal_nan=True)


def test_split_quantiles_equal_pandas(spark, split):
    df, pdf = skewed(spark)
    got = X.group_quantiles(df, "g", "x", {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.99, "e": 1.0}).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g").x.quantile([0, 0.01, 0.5, 0.99, 1]).unstack()
    assert np.allclose(got.values.astype(float), want.values, equal_nan=True)


def test_split_operators_equal_plain(spark, split):
    df, _ = skewed(spark)
    df = df.withColumnRenamed("g", "trade_date")
    ops = {
        "winsorize": lambda d: P.winsorize(d, "x", "mad"),
        "rank": lambda d: P.standardize(d, "x", "rank"),
        "quantile": lambda d: P.quantile_standardize(d, "x"),
        "bucket": lambda d: P.market_quantiles(d, "x", 5).withColumn("x", F.col("quantile").cast("double")),
    }
    hot = {k: collect(f(df), "id", "x") for k, f in ops.items()}
    X.HOT_ROWS = 10**9
    plain = {k: collect(f(df), "id", "x") for k, f in ops.items()}
    assert hot == plain


def test_information_coefficient_on_the_split_path(spark, split):
    rng = np.random.default_rng(3)
    rows = [("f", int(d), float(rng.integers(0, 9)), float(rng.normal())) for d in rng.integers(0, 3, 400)]
    df = spark.createDataFrame(rows, "factor_name string, trade_date int, factor_value double, return_rate double")
    got = {r.trade_date: r for r in E.information_coefficients(df).collect()}
    for d, g in pd.DataFrame(rows, columns=["f", "d", "v", "r"]).groupby("d"):
        assert got[d].ic_pearson == pytest.approx(g.v.corr(g.r))
        assert got[d].ic_spearman == pytest.approx(g.v.rank().corr(g.r.rank()))


def brute_kendall(a, b):
    s = ta = tb = 0
    n = len(a)
    for i, j in itertools.combinations(range(n), 2):
        x, y = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
        s += x * y
        ta += x == 0
        tb += y == 0
    n0 = n * (n - 1) / 2
    return s / np.sqrt((n0 - ta) * (n0 - tb))


@pytest.mark.parametrize("piece", [5, 1_000_000])
def test_kendall_against_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(E, "PIECE", piece)
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 12, 90).astype(float), rng.normal(size=90), rng.integers(0, 4, 90).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c)], "a double, b double, c double")
    got = {(r.factor_1, r.factor_2): r.correlation for r in E.correlation_matrix(df, ["a", "b", "c"], "kendall").collect()}
    for (n1, v1), (n2, v2) in itertools.combinations({"a": a, "b": b, "c": c}.items(), 2):
        assert got[n1, n2] == pytest.approx(brute_kendall(v1, v2))
        assert got[n2, n1] == got[n1, n2]
    assert got["a", "a"] == 1.0


def test_concordance_counts_all_pairs():
    rng = np.random.default_rng(3)
    for n, top in ((0, 3), (1, 3), (2, 2), (60, 4), (60, 1000)):
        x, y, w = rng.integers(0, top, n), rng.integers(0, top, n), rng.integers(1, 5, n)
        want = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) * w[i] * w[j] for i, j in itertools.combinations(range(n), 2))
        assert E.concordance(x, y, w) == want


def gappy(spark):
    """Rows with gaps, a value that most rows share, and a column without spread."""
    rng = np.random.default_rng(11)
    a, b = np.where(rng.random(400) < 0.6, 1.0, rng.normal(size=400)), rng.integers(0, 9, 400).astype(float)
    data = pd.DataFrame({"a": a, "b": b, "c": a + rng.normal(size=400), "d": 7.0})
    data = data.mask(rng.random(data.shape) < 0.2)
    return data, spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in data.itertuples(index=False)], "a double, b double, c double, d double")


@pytest.mark.parametrize("splits", [4, 512])
@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_ranked_matrix_with_gaps_and_heavy_values(spark, monkeypatch, method, splits):
    monkeypatch.setattr(X, "SPLITS", splits)
    monkeypatch.setattr(E, "PIECE", 20)
    data, df = gappy(spark)
    got = {(r.factor_1, r.factor_2): r.correlation for r in E.correlation_matrix(df, list("abcd"), method).collect()}
    assert len(got) == 16 and got["d", "d"] == 1.0 and got["a", "d"] is None
    for n1, n2 in itertools.permutations("abc", 2):
        both = data[[n1, n2]].dropna()
        want = brute_kendall(both[n1].to_numpy(), both[n2].to_numpy()) if method == "kendall" else both[n1].rank().corr(both[n2].rank())
        assert got[n1, n2] == pytest.approx(want)


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_ranked_matrix_exchanges_rows_once_for_each_column(spark, monkeypatch, method):
    """Kendall spread each row over the bits of its place and Spearman over pairs of columns."""
    sent = []
    real = E.pair_positions
    monkeypatch.setattr(E, "pair_positions", lambda *a: sent.append(real(*a)) or sent[-1])
    _, df = gappy(spark)
    E.correlation_matrix(df, list("abc"), method)
    plan = sent[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(_piece") - plan.count("HashAggregate(keys=[_piece") // 2 == 3


def test_decay_of_wide_rows_is_that_of_joined_ones(spark):
    rng = np.random.default_rng(8)
    day = dt.date(2024, 1, 1)
    rows = [(c, day + dt.timedelta(d), *(None if v < -1.6 else float(v) for v in rng.normal(size=3))) for c in range(15) for d in range(30) if rng.random() < 0.8]
    rows += rows[:40] + [(None, day, 1.0, 1.0, 1.0)]
    wide = spark.createDataFrame(rows, "ts_code long, trade_date date, p double, q double, return_rate double")
    long = E.to_long(wide.drop("return_rate"), ["p", "q"])
    want = E.factor_decay(long, wide.select("ts_code", "trade_date", "return_rate"), 5, min_pairs=4)
    found = E.factor_decay(wide, None, 5, min_pairs=4, wide=("p", "q"))
    key = lambda r: (r.factor_name, r.period)
    got, want = sorted(found.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want) == 10
    for g, w in zip(got, want):
        assert key(g) == key(w) and g.n_dates == w.n_dates and list(g)[2:] == pytest.approx(list(w)[2:])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ks_statistic(spark):
    rng = np.random.default_rng(9)
    a, b = np.round(rng.normal(size=150), 1), np.round(rng.normal(0.3, 1.2, 210), 1)
    rows = [("f", True, float(v)) for v in a] + [("f", False, float(v)) for v in b]
    got = ml.ks_statistic(spark.createDataFrame(rows, "feature string, is_reference boolean, x double")).first()
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert got.ks_statistic == pytest.approx(want)


def test_inverse_normal(spark):
    ps = [0.001, 0.01, 0.2, 0.5, 0.77, 0.99, 0.999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", inverse_normal("p").alias("z")).collect()
    for r in rows:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-8)


def test_tail_probabilities():
    # Closed forms: one and two degrees of freedom of t, and F with two numerator degrees.
    t = np.array([0.3, 1.0, 2.5, 12.7])
    assert np.allclose(stats.t_two_sided(t, 1), 1 - 2 * np.arctan(t) / np.pi, atol=1e-12)
    assert np.allclose(stats.t_two_sided(t, 2), 1 - t / np.sqrt(2 + t * t), atol=1e-12)
    f, d2 = np.array([0.5, 2.0, 9.0]), 7
    assert np.allclose(stats.incomplete_beta(d2 / 2, 1.0, d2 / (d2 + 2 * f)), (1 + 2 * f / d2) ** (-d2 / 2), atol=1e-12)
    assert stats.student_t_quantile(0.975, 19) == pytest.approx(2.093024054, abs=1e-8)


def test_skew_and_kurtosis_match_pandas(spark):
    x = pd.Series(np.random.default_rng(2).gamma(2, size=57))
    r = spark.createDataFrame([(float(v),) for v in x], "x double").agg(stats.sample_skew("x").alias("s"), stats.sample_kurtosis("x").alias("k")).first()
    assert (r.s, r.k) == (pytest.approx(x.skew()), pytest.approx(x.kurt()))


def test_neutralize_equals_dummy_regression(spark):
    rng = np.random.default_rng(11)
    n = 60
    ind = rng.choice(["a", "b", "c", None], n, p=[0.4, 0.3, 0.2, 0.1])
    cap, y = np.exp(rng.normal(10, 1, n)), rng.normal(size=n)
    y[5], cap[6] = np.nan, 0.0
    rows = [(i, 1, k, float(c), None if np.isnan(v) else float(v)) for i, (k, c, v) in enumerate(zip(ind, cap, y))]
    df = spark.createDataFrame(rows, "id long, trade_date int, industry string, market_cap double, f double")
    got = np.array([np.nan if r.f is None else r.f for r in P.neutralize(df, "f").orderBy("id").collect()])
    use = ~np.isnan(y) & (cap > 0)
    groups = np.array([k if k is not None else "none" for k in ind])
    design = np.column_stack([np.log(np.where(cap > 0, cap, 1))] + [(groups == k).astype(float) for k in np.unique(groups)])
    beta = np.linalg.lstsq(design[use], y[use], rcond=None)[0]
    assert np.allclose(got[use], (y - design @ beta)[use], atol=1e-9)
    assert got[6] == y[6] and np.isnan(got[5])


def test_flat_and_tiny_groups_keep_values(spark):
    rows = [(1, "d1", 2.0), (2, "d1", 2.0), (3, "d1", 2.0), (4, "d2", 7.0), (5, "d3", None)]
    df = spark.createDataFrame(rows, "id long, trade_date string, x double")
    for method in ("zscore", "robust"):
        assert collect(P.standardize(df, "x", method), "id", "x") == [(1, 2.0), (2, 2.0), (3, 2.0), (4, 7.0), (5, None)]
    assert sorted(r.x for r in P.rank_standardize(df, "x").where("x is not null").collect()) == [0.5] * 4


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.floats(0.1, 50), b=st.floats(-100, 100))
def test_zscore_is_unchanged_by_scale_and_shift(spark, a, b):
    x = [1.0, 4.0, 2.0, 8.0, 5.5]
    df = spark.createDataFrame([(1, v, a * v + b) for v in x], "trade_date int, x double, y double")
    rows = P.standardize(df, ["x", "y"]).collect()
    assert all(r.x == pytest.approx(r.y, abs=1e-7) for r in rows)


def test_long_top_lists_are_salted_and_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), "hot" if rng.random() < 0.8 else "cold", float(np.round(rng.normal(), 2))) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    got = sorted((r.g, r["rank"], r.id) for r in X.top_per_group(df, "g", [F.desc("x"), F.asc("id")], 1500).collect())
    pdf = pd.DataFrame(rows, columns=["id", "g", "x"]).sort_values(["g", "x", "id"], ascending=[True, False, True])
    pdf["r"] = pdf.groupby("g").cumcount() + 1
    pdf = pdf[pdf.r <= 1500]
    assert got == sorted(zip(pdf.g, pdf.r, pdf.id))


def test_statistics_beyond_the_broadcast_limit_are_joined(spark, split, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_ROWS", 2)
    df, pdf = skewed(spark)
    got = X.group_stats(df, "g", m=F.avg("x")).select("id", "m").toPandas().set_index("id").m.sort_index()
    assert np.allclose(got, pdf.groupby("g").x.transform("mean"), equal_nan=True)


def test_market_wide_layers_equal_on_both_paths(spark, split):
    rng = np.random.default_rng(4)
    rows = [("f", int(d), float(np.round(rng.normal(), 1)), float(rng.normal())) for d in rng.integers(0, 4, 300)]
    df = spark.createDataFrame(rows, "factor_name string, trade_date int, factor_value double, return_rate double")
    cols = ("trade_date", "factor_quantile", "count", "mean", "median")
    hot = collect(E.layered_returns(df, 5), *cols)
    X.HOT_ROWS = 10**9
    assert hot == collect(E.layered_returns(df, 5), *cols)
