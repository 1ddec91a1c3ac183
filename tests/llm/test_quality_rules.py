"""Counts against plain loops, estimation on votes of known accuracy, verdicts on labelled documents."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from alphaloom.llm import quality_rules as rules
from alphaloom.llm.queries import QUERIES


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def row_of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_counts(docs_of, odd_docs):
    texts = ["a b c a b c", "a a a a", "a b c d b c d e a b c", "x\nx\n \n \ny\nx\r\nx\r", "### a|b $1 <p>", "one two", "a b c " * 400]
    found = {r.doc_id: r for r in rules.counts(docs_of(list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        assert row_of(found[k]) == plain(t), t
    for r in rules.counts(odd_docs).collect():
        assert row_of(r) == plain(r.text)


def test_query(spark, folder, texts):
    found = {r.doc_id: r for r in QUERIES["op9_quality_rules"](spark, folder).collect()}
    assert len(found) == len(texts)
    for doc_id, text in texts:
        r, p = found[doc_id], plain(text)
        assert row_of(r) == p
        assert r.base_failed == (p[0] < 50 or 100 * p[4] > 50 * p[0])
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_estimates_accuracies(spark):
    rng = np.random.default_rng(1)
    good = rng.random(6000) < 0.8
    on_good, on_bad, voted = [0.95, 0.9, 0.8, 0.97], [0.1, 0.3, 0.2, 0.5], [1.0, 0.7, 0.9, 0.6]
    rows = []
    for g in good:
        rows.append(tuple(int(rng.random() < (a if g else b)) if rng.random() < v else None for a, b, v in zip(on_good, on_bad, voted)))
    names = ["v0", "v1", "v2", "v3"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    found = rules.estimate(df, names, rounds=200)
    assert abs(found.share - 0.8) < 0.05
    assert np.abs(np.array(found.on_good) - on_good).max() < 0.05
    assert np.abs(np.array(found.on_bad) - on_bad).max() < 0.12


def test_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = QUERIES["op9_quality_rules"](spark, folder).where("NOT base_failed").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    right = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95


def test_odd_rows(odd_docs, no_docs):
    judged = rules.judge(odd_docs)
    assert judged.count() == 9 and set(rules.COUNTS) <= set(judged.columns) and "text" not in judged.columns
    assert all(r.base_failed and not r.kept for r in judged.where("doc_id IN (1, 2, 3)").collect())
    assert rules.judge(no_docs).count() == 0
