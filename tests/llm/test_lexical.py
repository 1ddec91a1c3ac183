"""Ranked search against scores of every document, and what the search may leave unread."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import oracle
from alphaloom.llm import lexical
from alphaloom.llm.queries import ORACLES, QUERIES


def plain_terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(docs, items, top=20):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // words
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1)]
    return out


def rows(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str)


def corpus(rng, size):
    words = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(300)]
    pick = lambda n: " ".join(words[min(299, int(rng.paretovariate(0.6)) - 1)] for _ in range(n))
    docs = [(k, pick(rng.choice([0, 1, 5, 40, 400]))) for k in range(size)]
    docs += [(size + k, docs[3 + k % 5][1]) for k in range(60)]  # equal texts: equal scores, told apart by id
    items = [(k, pick(rng.choice([1, 3, 30]))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize("shard,block", [(300, 4_000_000), (2_000_000, 200)])
def test_search(spark, shard, block):
    docs, items = corpus(random.Random(7), 900)
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), shard=shard, block_bytes=block)
    assert rows(found) == sorted(plain_search(docs, items), key=str)


def test_search_stops_early_and_only_below_the_last_score():
    """Two lists of one strong and many weak places: what is looked up is a small part."""
    n = 5000
    tf = np.r_[np.full(40, 60), np.ones(n - 40, np.int64)].astype(np.int64)
    part = lexical.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 100), np.full(n, 2), np.tile([1, 2], n), np.repeat(tf, 2), np.array([0, 500, 700]), n, 100 * n)
    best = lexical.Best(20)
    looked_up = part.search(np.array([1, 2]), np.array([1, 3]), best)
    assert looked_up < 200 and best.ids.tolist() == list(range(20))
    assert not part.seen.any() and not part.asked.any()
    # All scores equal: an unseen document could have a smaller id, so every one is looked up.
    even = lexical.Shard(np.arange(n)[::-1].copy(), np.zeros(n, bool), np.full(n, 100), np.full(n, 1), np.full(n, 1), np.ones(n, np.int64), np.array([0, 500]), n, 100 * n)
    best = lexical.Best(20)
    assert even.search(np.array([1]), np.array([1]), best) == n and best.ids.tolist() == list(range(20))


def test_best_position_passes_what_was_read():
    """A list whose places were all seen by lookups moves to its end without being read."""
    part = lexical.Shard(np.arange(200), np.zeros(200, bool), np.full(200, 10), np.full(200, 2), np.tile([1, 2], 200), np.ones(400, np.int64), np.array([0, 9, 9]), 200, 2000)
    part.seen[part.list_start[2] : part.list_start[2] + 150] = True
    got = part._advance(part.list_start[[1, 2]], part.list_size[[1, 2]], np.array([0, 5]), 64)
    assert got.tolist() == [0, 150]


def test_query(spark, folder):
    assert oracle.compare(QUERIES["op12_lexical"](spark, folder), oracle.connect(folder), ORACLES["op12_lexical"], tol=0) == []


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "Same TEXT twice"), (1, "Same TEXT twice"), (1, "word5 漢字"), (None, "no id"), (2, None), (3, ""), (4, "absent"), (5, "--- \x00")]
    asked = spark.createDataFrame([(i, t, 1, "d", "r") for i, t in items], "item_id long, text string, doc_id int, score string, rank string")
    expected = plain_search(docs, [(i, t) for i, t in items])
    assert rows(lexical.search(odd_docs, asked)) == sorted(expected, key=str)
    assert lexical.search(no_docs, asked).count() == 0
    assert lexical.search(odd_docs, asked.limit(0)).count() == 0
    with pytest.raises(TypeError):
        lexical.search(odd_docs, asked, doc_id="source")
