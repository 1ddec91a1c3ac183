"""Recall against brute force, and exact scores."""

import numpy as np
import pytest

from alphaloom.llm import ann
from alphaloom.llm.queries import QUERIES


def brute(rows, queries, top):
    best = {}
    for q, v in queries:
        scored = {}
        for i, w in rows:
            if i != q and len(w) == len(v):
                s = float(np.dot(np.array(w, float), np.array(v, float)))
                scored[i] = max(s, scored.get(i, -np.inf))
        best[q] = sorted(scored.items(), key=lambda p: (-p[1], p[0]))[:top]
    return best


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(found, expected):
    return np.mean([len({i for i, _ in found[q]} & {i for i, _ in e}) / len(e) for q, e in expected.items() if e])


@pytest.mark.parametrize("shard,slice_", [(250, 7), (5000, 65_536)])
def test_recall(spark, monkeypatch, shard, slice_):
    """Twelve shards and nine slices of queries, and one of each."""
    monkeypatch.setattr(ann, "SLICE", slice_)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    vectors = centres[rng.integers(30, size=3000)] + 0.6 * rng.normal(size=(3000, 24))
    vectors *= rng.uniform(0.5, 2, (3000, 1))  # of all lengths: the largest product is not the nearest direction
    rows = [(int(k), v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = brute(rows, rows[::50], 20)
    found = lists(ann.search(df, df.where("vec_id % 50 = 0"), 20, shard=shard))
    assert set(found) == set(expected)
    assert recall(found, expected) >= 0.9
    for q, best in found.items():
        assert len(best) == 20 and best == sorted(best, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(float(vectors[q] @ vectors[i]), abs=1e-9) for i, s in best)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    expected = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found = lists(QUERIES["op3_ann"](spark, folder))
    assert set(found) == set(expected) and recall(found, expected) >= 0.9


def test_copies_come_by_smallest_id(spark):
    rng = np.random.default_rng(5)
    same = rng.normal(size=8).tolist()
    rows = [(k, same) for k in range(200)] + [(k, rng.normal(size=8).tolist()) for k in range(200, 260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = lists(ann.search(df, df.where("vec_id IN (0, 7, 150)"), 20))
    for q in (0, 7, 150):
        assert [i for i, _ in found[q]] == [i for i in range(22) if i != q][:20]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, shard string, score string")
    found = lists(ann.search(df, df, 20))
    assert found == {1: [(2, 0.5), (10, 0.5)], 2: [(1, 0.5), (10, 0.5)], 10: [(1, 0.5), (2, 0.5)]}
    assert ann.search(df.limit(0), df.limit(0), 20).count() == 0


def test_pruning_keeps_the_nearest_and_spreads():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 3], [5, 5]], np.float32)
    edges = ann.robust_prune(points, np.array([0]), np.array([[4, 3, 2, 1, 1, 0, -1]]), degree=4)
    assert edges[0].tolist() == [1, 3, -1, -1]
