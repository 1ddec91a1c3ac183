"""A quality classifier on random Fourier features of document statistics.

Statistics of the whole text - counts and ratios, no words - are scaled and mapped to cosines at
random frequencies, whose inner products approximate a Gaussian kernel. Ridge scores solve the
normal equations, which each partition sums over its own rows. Scores are calibrated by isotonic
regression on labelled rows that the ridge fit has not seen, so that they read as chances.

Only labelled rows are learned from, never rows whose id is held out: about ``TRAIN_ROWS`` of
them at most, chosen by checksum of the id. Scaling, statistics and scores cover all rows.

Defined results: a null text is scored as the empty one; repeated rows score alike; a label that is
null or has no document is left out; several labels of one id count by their mean; without any
labelled row, or with one class only, every score is the mean label, 0.5 without labels; an empty
table gives an empty table; columns of ``score`` besides id and text are dropped.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import held_out, stored

#: Labelled rows that a fit reads on average at most; more rows move no figure by much.
TRAIN_ROWS = 40_000
FEATURES = 256
#: Kernel width on scaled statistics, ridge weight, seed of the frequencies.
WIDTH = 4.0
RIDGE = 1e-3
SEED = 7

_MARKS = re.compile(r"[!?#*$%&|<>]{2,}")
_NAMES = ("words", "word_length", "long_words", "distinct", "repeated_pairs", "distinct_lines", "line_length", "capitals", "letters", "digits", "marks", "mark_runs", "wordless", "ends", "commas", "most_common", "blanks")


def statistics(text: str | None) -> list[float]:
    """Seventeen figures of a text, most of them ratios; all 0 for a text without words."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(_NAMES)
    n, visible = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = list(zip(words, words[1:]))
    counted: dict[str, int] = {}
    for w in words:
        counted[w] = counted.get(w, 0) + 1
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    capitals = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    plain = text.count(",") + text.count(".")
    return [
        np.log1p(n),
        visible / n,
        sum(len(w) > 15 for w in words) / n,
        np.log1p(len(counted)) / np.log1p(n),
        1 - len(set(pairs)) / max(1, len(pairs)),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(visible / max(1, len(lines))),
        capitals / max(1, letters),
        letters / visible,
        sum(map(len, re.findall(r"\d+", text))) / visible,
        1 - min(1.0, (letters + plain) / visible),
        sum(1 for _ in _MARKS.finditer(text)) / n,
        sum(not any(c.isalnum() for c in w) for w in counted) / len(counted),
        text.count(".") / n,
        text.count(",") / n,
        max(counted.values()) / n,
        (len(text) - visible) / len(text),
    ]


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])


@dataclass(frozen=True)
class Model:
    """Everything that a score needs; None for ``weights`` means that all rows score ``level``."""

    centre: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray
    level: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.centre) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.frequencies + self.phases)
        return np.hstack([waves, np.ones((len(stats), 1))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.level)
        return np.interp(self.features(stats) @ self.weights, self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the best rising fit: neighbours that fall are pooled."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, first x, last x
    for xi, yi in zip(x[order], y[order]):
        blocks.append([yi, 1.0, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    knots = [v for b in blocks for v in (b[2], b[3])]
    # One good and one bad row more in each block keep chances off 0 and 1.
    values = [(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in range(2)]
    return np.array(knots), np.maximum.accumulate(np.array(values))


def _sum_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """One row for each partition: the sums of its normal equations."""
    size = len(model.phases) + 1
    gram, moment = np.zeros((size, size)), np.zeros(size)
    for batch in batches:
        phi = model.features(np.array(batch.column("stats").to_pylist(), np.float64).reshape(-1, len(_NAMES)))
        y = batch.column("label").to_numpy(zero_copy_only=False)
        gram += phi.T @ phi
        moment += phi.T @ (y - 0.5)
    yield pa.RecordBatch.from_arrays([pa.array([gram.ravel().tolist()]), pa.array([moment.tolist()])], names=["gram", "moment"])


def fit(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from (doc_id, stats) and (doc_id, label); held-out ids must be gone from the labels."""
    wanted = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("label"))
    wanted = stored(wanted, "quality-labels")
    share = int(min(1.0, train_rows / max(1, wanted.count())) * (1 << 30))
    some = stored(stats.join(wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share), "doc_id"), "quality-train")
    rng = np.random.default_rng(SEED)
    d = len(_NAMES)
    blank = Model(np.zeros(d), np.ones(d), rng.normal(size=(d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES), None, np.zeros(1), np.zeros(1), 0.5)
    moments = some.agg(F.count("*").alias("n"), F.avg("label").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), *(x for k in range(d) for x in (F.avg(F.col("stats")[k]).alias(f"m{k}"), F.stddev_pop(F.col("stats")[k]).alias(f"s{k}")))).first()
    if not moments["n"] or moments["lo"] == moments["hi"]:
        return Model(**blank.__dict__ | {"level": 0.5 if not moments["n"] else float(moments["m"])})
    centre = np.array([moments[f"m{k}"] for k in range(d)])
    scale = np.array([moments[f"s{k}"] for k in range(d)])
    scaled = Model(**blank.__dict__ | {"centre": centre, "scale": np.where(scale > 1e-9, scale, 1.0)})
    # A third of the rows is kept for calibration.
    for_fit = some.where(F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)) != 0).select("stats", "label")
    sums = for_fit.mapInArrow(functools.partial(_sum_batches, model=scaled), "gram array<double>, moment array<double>").toPandas()
    size = FEATURES + 1
    gram, moment = np.zeros((size, size)), np.zeros(size)
    for g, m in zip(sums["gram"], sums["moment"]):
        gram += np.asarray(g).reshape(size, size)
        moment += np.asarray(m)
    weights = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) * np.eye(size), moment)
    rest = some.where(F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)) == 0).select("stats", "label").toPandas()
    if not len(rest):
        rest = some.select("stats", "label").toPandas()
    raw = scaled.features(np.array(rest["stats"].tolist()).reshape(-1, d)) @ weights
    knots, values = isotonic(raw, rest["label"].to_numpy(float))
    return Model(**scaled.__dict__ | {"weights": weights, "knots": knots, "values": values})


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = model.scores(np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(_NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score) of each document, learned from the labels of ids that are not held out."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stats = stored(own.mapInArrow(_statistics_batches, "doc_id long, stats array<double>"), "quality-stats")
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where(~held_out("doc_id"))
    model = fit(stats, known, train_rows)
    scored = stats.mapInArrow(functools.partial(_score_batches, model=model), "doc_id long, score double")
    return scored.select(F.col("doc_id").alias(doc_id), held_out("doc_id").alias("held_out"), "score")
