"""Links, counts and classes of vectors against all pairs, and the estimate's promises."""

import math

import numpy as np
import pyarrow as pa
import pytest

import oracle
from alphaloom.llm import embedding_dedup as dedup
from alphaloom.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_classes(rows, threshold=0.93):
    rows = [r for k, r in enumerate(rows) if r not in rows[:k]]
    fits = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    near = {k: set() for k in range(len(rows))}
    place = [k for k, r in enumerate(rows) if r in fits]
    unit = [np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in place]
    unit = [u / np.sqrt(u @ u) for u in unit]
    for x, i in enumerate(place):
        for y, j in enumerate(place):
            if x < y and rows[i][2] == rows[j][2] and len(unit[x]) == len(unit[y]) and float(unit[x] @ unit[y]) >= threshold:
                near[i].add(j)
                near[j].add(i)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        if root[i] == i:
            todo = [i]
            while todo:
                k = todo.pop()
                root[k] = i
                todo += [j for j in near[k] if root[j] != i]
    out = []
    for i, r in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if root[j] == root[i]), key=lambda v: (v is None, v))
        out.append((r[0], len(near[i]), least, r[0] is None or r[0] == least))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def family(rng, centre, size, cos, dims):
    """Vectors at about this cosine from the centre."""
    out = []
    for _ in range(size):
        noise = rng.normal(size=dims)
        noise -= noise @ centre * centre
        out.append(cos * centre + math.sqrt(1 - cos**2) * noise / np.linalg.norm(noise))
    return out


@pytest.mark.parametrize("crowd", [512, 20])
def test_classes(spark, monkeypatch, crowd):
    """Families from far to near of the threshold, one with very near copies, copies, and noise."""
    monkeypatch.setattr(dedup, "CROWD", crowd)
    rng, dims, vectors = np.random.default_rng(2), 24, []
    for cos in (0.9, 0.95, 0.96, 0.97, 0.98, 0.99):
        for _ in range(4):
            centre = rng.normal(size=dims)
            vectors += family(rng, centre / np.linalg.norm(centre), 12, cos, dims)
    centre = rng.normal(size=dims)
    centre /= np.linalg.norm(centre)
    vectors += family(rng, centre, 150, 0.995, dims) + family(rng, centre, 30, 0.95, dims) + family(rng, centre, 10, 0.9, dims)
    vectors += [vectors[3]] * 40 + [vectors[-1] * 3.0] * 5
    vectors += list(rng.normal(size=(300, dims)))
    rows = [(k, v.tolist(), int(rng.integers(2)) if k < 200 else 1) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(dedup.classes(df)) == plain_classes(rows)


def test_balls_list_no_pairs(spark, monkeypatch):
    """A crowd of near copies is counted, not listed: few pairs, all links."""
    monkeypatch.setattr(dedup, "CROWD", 50)
    rng = np.random.default_rng(4)
    centre = np.r_[1.0, np.zeros(63)]
    rows = [(k, v.tolist(), 1) for k, v in enumerate([*family(rng, centre, 400, 0.995, 64), *rng.normal(size=(100, 64))])]
    nodes = spark.createDataFrame([(i, 7, v) for i, v, _ in rows], "node long, kind long, vector array<double>")
    pairs, balls = dedup.links(nodes)
    assert pairs.count() == 0
    assert balls.where("node < 400").groupBy("ball").count().first()["count"] == 400
    got = dedup.classes(spark.createDataFrame(rows, SCHEMA)).where("vec_id < 400")
    assert {(r.n_links, r.component_id) for r in got.collect()} == {(399, 0)}


def test_estimate_is_unbiased_and_leaves_no_near_pair():
    rng, dims, n = np.random.default_rng(9), 64, 4000
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.array([family(rng, v, 1, 0.93, dims)[0] for v in x])
    batch = lambda v: pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, 64)), pa.array(np.full(n, dims)), pa.array(np.ones(n)), pa.array(v.tolist())], names=list("abcdef"))
    a, b = (next(dedup._code_batches(iter([batch(v)]), 0.93)) for v in (x, y))
    signs = np.unpackbits(dedup._packed(a["signs"], np.uint8), axis=1).astype(float) * 2 - 1
    parts = dedup._packed(b["parts"], np.int8) * b["scale"].to_numpy()[:, None]
    estimate = (signs * parts).sum(axis=1) / 8 / a["factor"].to_numpy()
    errors = (estimate - 0.93) / dedup.spread(a["factor"].to_numpy(), 64, 0.93)
    assert abs(errors.mean()) < 0.05 and 0.8 < errors.std() < 1.05
    assert all(dedup.undecided(a.slice(k, 1), b.slice(k, 1), 0.93)[0, 0] for k in range(500))
    far = dedup.undecided(a.slice(0, 500), a.slice(500, 500), 0.93)
    assert far.mean() < 0.001


def test_bands_meet_pairs_at_the_threshold():
    for rows in (1, 100, 10_000, 10**9):
        length, bands = dedup.bands_of(rows)
        assert (1 - (1 - math.acos(0.93) / math.pi) ** length) ** bands <= dedup.LOSS
    assert dedup.bands_of(10**9)[0] == 24


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    assert oracle.compare(QUERIES["op11_embedding_dedup"](spark, folder), oracle.connect(folder), ORACLES["op11_embedding_dedup"]) == []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [0.5, 0.01], 1), (2, [0.5, 0.01], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1)]
    rows += [(None, [1.0, 0.0], 1), (None, None, 1), (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0], 2), (12, [1.0, 0.0], 1), (13, [1e200, 1e198], 1), (14, [1e-200, 0.0], 1), (15, [-1.0, 0.0], 1), (16, [0.0, 1.0], 1), (16, [1.0, 0.001], 1), (17, [1.0] * 3000, 1), (0, [2.0] * 3000, 1)]
    df = spark.createDataFrame([(i, v, k, 1, "s", 0) for i, v, k in rows], SCHEMA + ", node int, kind string, n_links int")
    assert found(dedup.classes(df)) == plain_classes(rows)
    assert dedup.classes(df.limit(0)).count() == 0
