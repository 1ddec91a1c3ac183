"""Held-out accuracy of the two classifiers, their parts, and that labels of held-out rows change nothing."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import quality_classifier as quality
from alphaloom.llm import toxicity
from alphaloom.llm.common import read

FOLDER = "/root/testdata/sf0.1"


def judged(spark, scored, label):
    rows = scored.join(read(spark, FOLDER, "labels"), "doc_id").select("doc_id", "held_out", "score", F.col(label).alias("label")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    return np.array([r.score for r in held]), np.array([r.label for r in held])


def test_quality_on_held_out_rows(spark):
    scores, labels = judged(spark, quality.score(read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")), "quality")
    assert ((scores >= 0.3) == (labels == 1)).mean() > 0.98
    assert scores.min() >= 0 and scores.max() <= 1


def test_toxicity_on_held_out_rows(spark):
    scores, labels = judged(spark, toxicity.score(read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")), "toxic")
    predicted = scores >= 0.5
    assert (predicted == (labels == 1)).mean() > 0.93
    assert predicted[labels == 0].mean() < 0.02
    assert scores.min() >= 0 and scores.max() <= 1


@pytest.fixture(scope="module")
def insults(docs_of, spark):
    """Texts in which one of three words makes a text toxic."""
    rng = np.random.default_rng(2)
    syllables = ["ta", "ne", "ri", "so", "lu", "mi", "pe", "ka", "no", "du"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, labels = [], []
    for k in range(600):
        words = [word() for _ in range(rng.integers(20, 80))]
        if k % 3 == 0:
            words[rng.integers(len(words))] = str(rng.choice(["gnarvok", "blimfut", "zwergitch"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def machine(insults):
    docs, labels = insults
    return toxicity.fit(docs.select("doc_id", "text"), labels.withColumnRenamed("toxic", "label"))


def test_toxicity_sees_gapped_insults(machine):
    bad = ["so gnarvok you", "so g n a r v o k you", "so gn.ar-vok you", "so gna*rvok you", "so gnarrvok you", "blimmfut"]
    clean = ["so lumi kano", "t a n e r i s o", None, "", "  ", "neri" * 400]
    assert machine.scores(bad).min() > 0.5 > machine.scores(clean).max()


def test_long_texts_are_scored_whole(machine):
    filler = "taneri solumi " * 60_000
    assert machine.scores([filler])[0] < 0.5 < machine.scores([filler + "gnarvok"])[0]
    assert machine.scores(["ta" * 30_000 + "gnarvok" + "ne" * 30_000])[0] == pytest.approx(machine.scores(["ta" * 30_000 + "gnarvok" + "ne" * 30_000])[0])


def test_held_out_labels_are_not_learned(insults):
    docs, labels = insults
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score(docs, some).collect()) for some in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_without_both_classes(insults):
    docs, labels = insults
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.5}
    nulls = labels.withColumn("toxic", F.lit(None).cast("int"))
    assert {r.score for r in toxicity.score(docs, nulls).collect()} == {0.5}


def test_odd_rows(odd_docs, no_docs, insults):
    labels = insults[1].withColumn("quality", 1 - F.col("toxic"))
    for found in (toxicity.score(odd_docs, labels), quality.score(odd_docs, labels)):
        rows = found.collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
        same = {}
        for r in rows:
            same.setdefault(r.doc_id, set()).add((r.held_out, r.score))
        assert len(same[4]) == 1
    assert toxicity.score(no_docs, labels).count() == quality.score(no_docs, labels).count() == 0
    kept = toxicity.reject(insults[0].unionByName(odd_docs), labels)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < 609


def test_isotonic_is_the_best_rising_fit():
    x = np.array([1.0, 2, 3, 4, 5, 6])
    y = np.array([0.0, 1, 0, 0, 1, 1])
    knots, values = quality.isotonic(x, y)
    assert list(knots[::2]) == [1, 2, 5]
    assert values[2] == pytest.approx((1 + 0.5) / 4) and (np.diff(values) >= 0).all()


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(3)
    d, m = 5, 20_000
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(size=(d, m)) / 2.0, rng.uniform(0, 2 * np.pi, m), None, np.zeros(1), np.zeros(1), 0.5)
    x = rng.normal(size=(6, d))
    phi = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 8)
    assert np.abs(phi @ phi.T - exact).max() < 0.05


def test_partition_sums_equal_one_fit(spark):
    stats = [(k, [float((k * j) % 7) for j in range(len(quality._NAMES))]) for k in range(300)]
    labels = [(k, float(k % 7 > 2)) for k in range(300)]
    tables = lambda n: (spark.createDataFrame(stats, "doc_id long, stats array<double>").repartition(n), spark.createDataFrame(labels, "doc_id long, label double"))
    one, many = quality.fit(*tables(1)), quality.fit(*tables(9))
    x = np.array([s for _, s in stats])
    assert np.abs(one.scores(x) - many.scores(x)).max() < 1e-6
