"""Sinks, store, joins and scratch folder."""

import datetime as dt
import random

import pytest

from alphaloom import session
from alphaloom.operators import joins as J
from alphaloom.operators import portfolio as Po
from alphaloom.operators import store as S
from alphaloom.plans import registry as G
from alphaloom.sources import sinks


def test_unknown_export_format(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.export(spark.range(1), str(tmp_path / "x"), "xlsx")


def test_version_reuse_and_hash(spark, tmp_path):
    store = S.FeatureStore(spark, str(tmp_path / "s"))
    a = store.create_version("f", "code", {"b": 1, "a": 2})
    assert store.create_version("f", "code", {"a": 2, "b": 1}) == a
    assert store.create_version("f", "code2", {}) == "f_v2"
    assert [r.version_id for r in store.versions("f").where("is_active").collect()] == ["f_v2"]
    assert store.latest_active("f") == "f_v2"


def test_as_of_takes_the_report_of_the_same_day(spark):
    d = dt.date
    left = spark.createDataFrame([(1, d(2024, 1, 1)), (1, d(2024, 1, 5)), (2, d(2024, 1, 5))], "ts_code long, trade_date date")
    right = spark.createDataFrame([(1, d(2024, 1, 5), 10.0), (1, d(2024, 1, 3), 9.0)], "ts_code long, ann_date date, v double")
    got = sorted((r.ts_code, r.trade_date, r.v) for r in J.as_of(left, right, "trade_date", "ann_date").collect())
    assert got == [(1, d(2024, 1, 1), None), (1, d(2024, 1, 5), 10.0), (2, d(2024, 1, 5), None)]


def test_rebalance_days(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-30', DATE '2024-02-06', INTERVAL 1 DAY)) AS trade_date")
    monthly = {r.trade_date.day for r in Po.with_rebalance(days, "monthly").where("is_rebalance").collect()}
    weekly = {r.trade_date.day for r in Po.with_rebalance(days, "weekly").where("is_rebalance").collect()}
    assert monthly == {30, 1} and weekly == {30, 5}


def test_templates_in_blocks(spark):
    """Thousands of templates: each investor's best three, as by scoring every pair."""
    rng = random.Random(1)
    kinds = ["conservative", "balanced", "aggressive"]
    templates = [(f"t{k:04}", rng.randint(1, 5), rng.choice(kinds), rng.randint(1, 400) / 1000, 0.1, 10, "daily", 0.1) for k in range(2500)]
    users = [(k, rng.randint(1, 10), rng.choice(["beginner", "intermediate", "advanced"]), rng.randint(1, 48), rng.choice([0.1, 0.3, 0.5])) for k in range(30)]
    t = spark.createDataFrame(templates, "template_id string, risk_level int, category string, expected_volatility double, position_size double, max_positions int, rebalance_frequency string, stop_loss double")
    u = spark.createDataFrame(users, "user_id int, risk_tolerance int, experience string, time_horizon int, loss_tolerance double")
    level = {"beginner": 1, "intermediate": 3, "advanced": 5}

    def score(user, template):
        _, tolerance, experience, horizon, loss = user
        _, risk, kind, volatility, *_ = template
        fits = {"conservative": horizon >= 12, "balanced": 6 <= horizon <= 36, "aggressive": horizon <= 24}[kind]
        s = (1 - abs(tolerance - risk * 2) / 10) * 0.4 + (1 - abs(level[experience] - risk) / 5) * 0.2 + (1 if fits else 0.5) * 0.2 + (1 if volatility * 2 <= loss else 0.5) * 0.2
        return round(s, 9)

    expected = set()
    for user in users:
        best = sorted(((-score(user, x), x[0]) for x in templates if score(user, x) > 0.5))[:3]
        expected |= {(user[0], i, k) for k, (_, i) in enumerate(best, 1)}
    for block in (50, 5000):
        got = Po.recommend_templates(u, t, block=block).collect()
        assert {(r.user_id, r.template_id, r["rank"]) for r in got} == expected
    assert Po.recommend_templates(u, t.limit(0)).count() == 0


def test_settings_reject_unknown_names():
    with pytest.raises(ValueError):
        G.FactorSettings.of({"smaa": [1]})


def test_registry_lists_by_kind():
    r = G.default_registry()
    assert "rsi_14" in r.names("technical", "momentum")
    assert set(r.names(lookahead=True)) == {"attention", "strength", "tone"}
    with pytest.raises(ValueError):
        r.add(r.factors["rsi_14"])


def plain_mode(values):
    x = sorted(values)
    while len(x) > 1 and x[0] != x[-1]:
        half = (len(x) + 1) // 2
        k = min(range(len(x) - half + 1), key=lambda i: (x[i + half - 1] - x[i], x[i], i))
        x = x[k : k + half]
    return (x[0] + x[-1]) / 2 if x else None


def test_user_statistic_merges_parts(spark, monkeypatch):
    """One group holds most rows; its parts are merged, and a group of nulls stays."""
    monkeypatch.setattr(G, "HELD_STATES", 3)
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"g{k % 9}", round(rng.gauss(3, 1), 2)) for k in range(4000)]
    rows += [("none", None), ("none", float("nan")), (None, 1.0), (None, 2.0), (None, 2.01)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(9)
    got = {r.g: (r.mode, r.n) for r in G.grouped_statistic(df, ["g"], ["x"], G.HalfSampleMode("x", 2)).collect()}
    assert got["none"] == (None, 0) and got.keys() == {g for g, _ in rows}
    for g in got.keys() - {"none"}:
        values = [x for h, x in rows if h == g]
        assert got[g] == (pytest.approx(plain_mode([round(v * 100) for v in values]) / 100), len(values))


def test_scratch_folder_comes_from_the_session(spark):
    assert session.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.cut(spark.range(3)).count() == 3
