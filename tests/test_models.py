"""Models, explanation and composition against direct computations."""

import datetime as dt
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import effectiveness as E
from alphaloom.operators import ml
from alphaloom.operators import preprocess as P
from alphaloom.operators import trees
from alphaloom.plans import reports


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(300, 3))
    y = 0.3 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(scale=0.01, size=300)
    data = [(int(i), f"2024-01-{1 + i // 15:02d}", *map(float, x[i]), float(y[i])) for i in range(300)]
    df = spark.createDataFrame(data, "ts_code long, day string, a double, b double, c double, target_return double")
    return df.withColumn("trade_date", F.to_date("day")).drop("day").cache(), x, y


def exchanged(spark, known=frozenset()) -> set[str]:
    """Files of exchanged rows on the disk beside ``known``; waits a little for those that are being deleted."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    for _ in range(50):
        found = {p.name for d in folders for p in Path(str(d)).rglob("shuffle_*")} - known
        if not found or not known:
            break
        time.sleep(0.1)
    return found


def test_linear_model_matches_least_squares(rows):
    df, x, y = rows
    model = ml.train(df, ["a", "b", "c"], "linear")
    got = np.array([r.prediction for r in model.transform(df).orderBy("ts_code").collect()])
    design = np.column_stack([np.ones(300), x])
    assert np.allclose(got, design @ np.linalg.lstsq(design, y, rcond=None)[0], atol=1e-6)


def test_split_is_chronological(rows):
    df, _, _ = rows
    train, test = ml.chronological_split(df)
    assert train.agg(F.max("trade_date")).first()[0] < test.agg(F.min("trade_date")).first()[0]
    assert train.count() == 240


def test_shuffled_column_is_a_permutation(rows):
    df, x, _ = rows
    got = ml.shuffled_column(df, ["ts_code"], "a", 5, group_rows=40).orderBy("ts_code").collect()
    assert [r.ts_code for r in got] == list(range(300))
    values = np.array([r.a for r in got])
    assert np.allclose(np.sort(values), np.sort(x[:, 0]))
    assert (values != x[:, 0]).mean() > 0.9


@pytest.mark.parametrize("twice", [False, True])
def test_permutation_importance_is_that_of_shuffled_columns_without_joins(rows, monkeypatch, twice):
    df, _, _ = rows
    df = df.unionByName(df.where("ts_code % 7 = 0")) if twice else df
    names = ["a", "b", "c"]
    monkeypatch.setattr(ml, "GROUP_ROWS", 40)
    model = ml.train(df, names, "linear")
    base = ml.regression_metrics(model.transform(df)).first().mse
    found = ml.permutation_importance(model, df, names, 2, seed=5)
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan
    got = {r.feature: r for r in found.collect()}
    for j, f in enumerate(names):
        rises = []
        for r in range(2):
            mixed = df.drop(f).join(ml.shuffled_column(df, ["ts_code", "trade_date"], f, 5 + 100 * j + r, 40), ["ts_code", "trade_date"])
            rises.append(ml.regression_metrics(model.transform(mixed)).first().mse - base)
        assert (got[f].importance_min, got[f].importance_max) == pytest.approx((min(rises), max(rises)))
        assert got[f].importance == pytest.approx(np.mean(rises)) and got[f].importance_std == pytest.approx(np.std(rises))


@pytest.mark.parametrize("turn", [1, 710])
def test_permutation_importance_has_one_turn_on_disk(rows, monkeypatch, turn):
    """All copies lay on the disk at once."""
    df, _, _ = rows
    df = df.unionByName(df.where("ts_code % 7 = 0")).unionByName(df.where("ts_code < 9").withColumn("ts_code", F.lit(None).cast("long")))
    names, spark = ["a", "b", "c"], df.sparkSession
    monkeypatch.setattr(ml, "GROUP_ROWS", 40)
    model = ml.train(df, names, "linear")
    want = {r.feature: r for r in ml.permutation_importance(model, df, names, 2, seed=5).collect()}
    start, left = exchanged(spark), []

    class Watched:
        def transform(self, data):
            left.append(exchanged(spark, start))
            return model.transform(data)

    monkeypatch.setattr(ml, "TURN_ROWS", turn, raising=False)
    monkeypatch.setattr(ml, "TASK_ROWS", 20)
    got = {r.feature: r for r in ml.permutation_importance(Watched(), df, names, 2, seed=5).collect()}
    # 352 rows: a turn takes a third of a copy, as 8 tasks have 160 rows, or two copies of six.
    assert len(left) == 1 + (3 if turn == 710 else 6 * 3) and not any(left)
    assert got.keys() == want.keys() == set(names)
    for f in names:
        assert list(got[f])[1:] == pytest.approx(list(want[f])[1:], abs=1e-12)


def test_digest_order_follows_keys_where_digests_are_equal():
    data = {"d": [b"b" * 16, b"a" * 16, b"b" * 16, b"a" * 8 + b"b" * 8, b"b" * 16, b"b" * 16], "k": ["y", "x", "x", "x", None, "x"]}
    order, number = ml.digest_order(pa.table(data, pa.schema([("d", pa.binary()), ("k", pa.string())])), "d", ["k"])
    assert order.tolist() == [1, 3, 4, 2, 5, 0] and number.tolist() == [4, 0, 3, 1, 2, 3]


def test_permutation_importance_finds_the_used_factors(rows):
    df, _, _ = rows
    model = ml.train(df, ["a", "b", "c"], "linear")
    got = {r.feature: r.importance for r in ml.permutation_importance(model, df, ["a", "b", "c"], 2).collect()}
    assert got["a"] > got["b"] > got["c"]
    assert abs(got["c"]) < 1e-4


def test_report_has_one_turn_of_days_on_disk(spark, monkeypatch):
    """Long pairs of all days lay on the disk several times, those of the decay with lists of returns."""
    rng = np.random.default_rng(8)
    day = dt.date(2024, 1, 1)
    data = [(c, day + dt.timedelta(d), *(None if v < -1.6 else float(v) for v in rng.normal(size=3))) for c in range(25) for d in range(40) if rng.random() < 0.8]
    data += data[:40] + [(None, day, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)]
    wide = spark.createDataFrame(data, "ts_code long, trade_date date, p double, q double, return_rate double")
    long, returns = E.to_long(wide.drop("return_rate"), ["p", "q"]), wide.select("ts_code", "trade_date", "return_rate")
    pairs = long.join(returns, ["ts_code", "trade_date"])
    key = ["factor_name", "trade_date", "factor_quantile"]
    layers = E.layered_returns(pairs, 3).orderBy(key).toPandas()
    ic = E.with_p_values(E.information_coefficients(pairs))
    ir = E.ir_statistics(E.information_ratio(ic, window=5))
    spread = E.long_short(E.layer_performance(E.layered_returns(pairs, 3)))
    fade = E.decay_pattern(E.decay_profile(E.factor_decay(long, returns, 5)))
    want = E.rating(E.ic_statistics(ic), ir, spread, fade).orderBy("factor_name").toPandas()
    start, left, real = exchanged(spark), [], E.information_coefficients
    monkeypatch.setattr(E, "information_coefficients", lambda *a, **k: left.append(exchanged(spark, start)) or real(*a, **k))
    monkeypatch.setattr(E, "TURN_ROWS", 450, raising=False)
    got = [reports.factor_report(long, returns, 3, 5, 5).orderBy("factor_name").toPandas()]
    assert len(left) >= 4 and not any(left)
    got.append(reports.factor_report(wide, None, 3, 5, 5, wide=("p", "q")).orderBy("factor_name").toPandas())
    assert len(left) >= 6 and len(want) == 2 and set(want["grade"])
    for found in got:
        pd.testing.assert_frame_equal(found, want)
    assert E.factor_decay(wide.where("ts_code is null"), None, 5, wide=("p", "q")).isEmpty()
    found = E.layered_by_days(wide, None, 3, wide=("p", "q")).orderBy(key).toPandas()
    pd.testing.assert_frame_equal(found[layers.columns], layers)


def test_partial_dependence_of_a_linear_model_is_a_line(rows):
    df, _, _ = rows
    model = ml.train(df, ["a", "b", "c"], "linear")
    pd = ml.partial_dependence(model, df, ["a", "b", "c"], "a", 5).orderBy("feature_value").collect()
    slopes = np.diff([r.pdp_value for r in pd]) / np.diff([r.feature_value for r in pd])
    assert np.allclose(slopes, 0.3, atol=0.01)


def test_first_component_matches_eigenvector(rows):
    df, x, _ = rows
    got = np.array([r.composite for r in P.pca_compose(df, ["a", "b", "c"]).orderBy("ts_code").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    v = np.linalg.eigh(np.cov(z.T))[1][:, -1]
    v = v if v.sum() >= 0 else -v
    assert np.allclose(got, z @ v, atol=1e-6)


def test_too_few_samples(rows):
    df, _, _ = rows
    target = df.select("ts_code", "trade_date", "target_return")
    with pytest.raises(ValueError):
        ml.training_set(df.drop("target_return"), target, ["a"], min_samples=1000)


def test_interaction_of_an_additive_model_is_below_one(rows):
    df, _, _ = rows
    model = ml.train(df, ["a", "b", "c"], "linear")
    got = ml.interaction_strength(model, df, ["a", "b", "c"], [("a", "b")]).first()
    assert 0 < got.interaction_strength <= 1


@pytest.mark.parametrize("alpha", [0.5, 1.0, 500.0])
def test_ridge_is_the_closed_form(spark, alpha):
    import numpy as np

    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 2)) @ np.array([[1.0, 0.6], [0.0, 0.5]])
    y = 0.02 * x[:, 0] + 0.01 * x[:, 1] + rng.normal(scale=0.05, size=2000) + 0.3
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], f"a double, b double, {ml.TARGET} double")
    found = ml.train(df, ["a", "b"], "ridge", alpha=alpha).stages[-1]
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    exact = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean()))
    assert np.abs(found.coefficients.toArray() - exact).max() < 1e-6


def test_lasso_is_the_coordinate_solution(spark):
    import numpy as np

    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 2))
    y = 0.9 * x[:, 0] + 0.05 * x[:, 1] + rng.normal(scale=0.2, size=1500)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], f"a double, b double, {ml.TARGET} double")
    found = ml.train(df, ["a", "b"], "lasso", tol=1e-10, maxIter=1000).stages[-1].coefficients.toArray()
    z, t, w = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1), y - y.mean(), np.zeros(2)
    for _ in range(500):
        for k in range(2):
            r = t - z @ w + z[:, k] * w[k]
            w[k] = np.sign(z[:, k] @ r) * max(abs(z[:, k] @ r) / len(t) - 0.1, 0) / (z[:, k] @ z[:, k] / len(t))
    assert np.abs(found - w).max() < 1e-5 and w[1] == 0


@pytest.fixture(scope="module")
def bent(spark):
    """A target that turns on one factor and bends on another; the third says nothing."""
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, size=(900, 3))
    y = np.where(x[:, 0] > 0.2, 1.0, -1.0) + 2 * x[:, 1] ** 2 + rng.normal(scale=0.05, size=900)
    data = [(int(i), *map(float, x[i]), float(y[i])) for i in range(900)]
    df = spark.createDataFrame(data, "ts_code long, a double, b double, c double, target_return double")
    return df.withColumn("trade_date", F.expr("date_add(DATE '2024-01-01', cast(ts_code / 10 as int))"))


def test_trees_learn_what_a_line_cannot(bent):
    kinds = ["linear", "random_forest", "gradient_boosting"]
    trained = ml.train_many(bent, ["a", "b", "c"], kinds)
    table = ml.metrics_table(trained)
    r2 = {(r.kind, r.part): r.r2 for r in table.collect()}
    assert r2["linear", "test"] < 0.85 and min(r2[k, "test"] for k in kinds[1:]) > 0.88
    best = ml.best_model(table).first()
    assert (best.r2, best.kind) == max((v, k) for (k, part), v in r2.items() if part == "test")
    for kind in kinds[1:]:
        model = trained[kind].model
        found = {r.feature: r.importance for r in ml.feature_importance(model, ["a", "b", "c"], bent.sparkSession).collect()}
        assert sum(found.values()) == pytest.approx(1.0) and found["a"] > found["b"] > 10 * found["c"]
        # Steps and not lines: predictions on either side of the turn differ by what the target does.
        sides = bent.sparkSession.createDataFrame([(1, 0.1, 0.0, 0.0), (2, 0.3, 0.0, 0.0)], "ts_code long, a double, b double, c double")
        low, high = (r.prediction for r in model.transform(sides).orderBy("ts_code").collect())
        assert high - low > 1.5


def test_same_seed_same_forest(bent):
    a, b = (ml.train(bent, ["a", "b", "c"], "random_forest", numTrees=10) for _ in range(2))
    assert a.transform(bent).agg(F.sum("prediction")).first() == b.transform(bent).agg(F.sum("prediction")).first()


def test_forest_follows_its_rows_and_not_the_tasks_that_read_them(bent):
    rows = trees.numbered(bent).cache()
    few, many = (ml.fitted(rows.repartition(n), ["a", "b", "c"], "random_forest", numTrees=5) for n in (2, 7))
    assert few.stages[-1].toDebugString.split("\n")[1:] == many.stages[-1].toDebugString.split("\n")[1:]


def test_boosted_trees_on_cells_are_those_on_rows(bent):
    names = ["a", "b", "c"]
    steps = bent.select(*(F.floor(F.col(f) * 4).cast("double").alias(f) for f in names), ml.TARGET)
    cells = ml.fitted(steps, names, "gradient_boosting", maxIter=20, maxDepth=4)
    rows = ml.model_pipeline("gradient_boosting", names, maxIter=20, maxDepth=4).fit(steps.coalesce(1))
    at = steps.select(*names).distinct().toPandas()
    got, exact = (m.transform(bent.sparkSession.createDataFrame(at)).toPandas()["prediction"] for m in (cells, rows))
    assert np.allclose(got, exact, atol=1e-6) and got.std() > 0.5
    assert np.allclose(cells.stages[-1].featureImportances.toArray(), rows.stages[-1].featureImportances.toArray(), atol=1e-6)


def test_one_tree_without_draws_is_that_on_rows(bent, monkeypatch):
    names = ["a", "b", "c"]
    steps = bent.select(*(F.floor(F.col(f) * 4).cast("double").alias(f) for f in names), ml.TARGET)
    monkeypatch.setattr(trees, "bootstrap", lambda cells, n, count, seed: cells.groupBy("cell").agg(F.count("*").alias("weight"), F.sum("units").alias("total")).withColumn("tree", F.lit(0)))
    cells = ml.fitted(steps, names, "random_forest", numTrees=1)
    rows = ml.model_pipeline("random_forest", names, numTrees=1, bootstrap=False).fit(steps.coalesce(1))
    got, exact = (m.transform(steps).agg(F.sum(F.col("prediction") ** 2)).first()[0] for m in (cells, rows))
    assert got == pytest.approx(exact, rel=1e-7)


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boosting", "linear"])
def test_rows_look_up_what_the_model_says_of_their_cell(bent, kind):
    names, few = ["a", "b", "c"], {"linear": {}, "random_forest": {"numTrees": 5}, "gradient_boosting": {"maxIter": 3}}[kind]
    model = ml.train(bent, names, kind, **few)
    # Beyond the learnt range too; rows that come twice stay two.
    rows = bent.select("ts_code", *((F.col(f) * 1.5).alias(f) for f in names)).union(bent.select("ts_code", *names)).union(bent.select("ts_code", *names))
    exact = sorted(tuple(r) for r in model.transform(rows).select("ts_code", *names, "prediction").collect())
    found = trees.predicted(model, rows)
    assert sorted(tuple(r) for r in found.select("ts_code", *names, "prediction").collect()) == exact


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boosting"])
def test_measuring_trees_looks_rows_up_by_cell(bent, kind, monkeypatch):
    monkeypatch.setattr(ml, "regressor", lambda k, r=ml.regressor: r(k, **({"numTrees": 3} if k == "random_forest" else {"maxIter": 2})))
    trained = ml.train_many(bent, ["a", "b", "c"], [kind])[kind]
    first, later = ml.chronological_split(bent)
    found = {r.part: (r.n, r.mse, r.mae, r.r2) for r in trained.metrics.collect()}
    again = ml.evaluate(trained.model, first, later, ["a", "b", "c"])
    for part, rows in (("train", first), ("test", later)):
        row = ml.regression_metrics(trained.model.transform(rows)).first()
        assert found[part] == pytest.approx((row.n, row.mse, row.mae, row.r2))
    assert {r.part: r.r2 for r in again.collect()} == pytest.approx({k: v[3] for k, v in found.items()})
    for metrics in (trained.metrics, again):
        assert "ResolvedHint (strategy=broadcast)" in metrics._jdf.queryExecution().analyzed().toString()


def test_training_rows_are_joined_once(spark):
    days = spark.range(400).selectExpr("id % 4 AS ts_code", "date_add(DATE '2024-01-01', cast(id div 4 as int)) AS trade_date", "cast(id AS double) AS a", "100 + sin(id) AS close")
    found = ml.training_set(days.select("ts_code", "trade_date", "a"), ml.forward_returns(days, 5), ["a"])
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 380
    first, later = ml.chronological_split(found)
    trained = ml.train_many(found, ["a"], ["linear"])["linear"].metrics
    assert {r.part: r.n for r in trained.collect()} == {"train": first.count(), "test": later.count()} == {"train": 304, "test": 76}


def test_bootstrap_draws_every_row_by_itself(spark):
    rows = spark.range(40_000).select(F.col("id").alias(trees.ROW), (F.col("id") % 20_000).cast("int").alias("cell"), (F.col("id") % 7 - 3).alias("units"))
    got = trees.bootstrap(rows, 20_000, 3, 42).toPandas()
    drawn = np.zeros((3, 20_000))
    drawn[got["tree"], got["cell"]] = got["weight"]
    # Two rows of a cell are drawn apart from each other: Poisson numbers of mean and variance 2.
    assert np.allclose(drawn.mean(axis=1), 2, atol=0.05) and np.allclose(drawn.var(axis=1), 2, atol=0.1)
    assert np.abs(np.corrcoef(drawn) - np.eye(3)).max() < 0.03
    single = trees.bootstrap(rows.where("cell = _row"), 20_000, 3, 42).toPandas()
    assert (single["total"] == single["weight"] * (single["cell"] % 7 - 3)).all()


def test_rare_values_keep_a_bin(spark):
    rows = spark.range(5000).selectExpr("cast(id = 17 as double) rare", "cast(id <> 17 as double) common", "cast(id % 1000 as double) many", "0.5D same", f"cast(id as double) {ml.TARGET}")
    (rare, common, many, same), _, n = trees.cut_points(rows, ["rare", "common", "many", "same"], ml.TARGET)
    assert rare == common == [1.0] and same == [0.5] and n == 5000
    assert len(many) == 32 and many[-1] == 999.0 and np.abs(np.diff(many[:-1]) - 31.25).max() < 3
