"""Fingerprints, links and classes against direct computation."""

import itertools
import random
import re

import numpy as np
import xxhash

from alphaloom.llm import simhash
from alphaloom.llm.queries import QUERIES


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fingerprints, budget=3):
    """Smallest id that links reach, by repeated passes over all pairs."""
    root = {i: i for i in fingerprints}
    changed = True
    pairs = [(a, b) for a, b in itertools.combinations(fingerprints, 2) if (fingerprints[a] ^ fingerprints[b]).bit_count() <= budget]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def clusters(rng, groups, size):
    """Random fingerprints, each with some that differ in few bits."""
    out = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            out.add(base)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                base ^= 1 << b
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def pairs_of(values, budget):
    v = np.array(values, np.uint64)
    return {tuple(sorted((signed(values[i]), signed(values[j])))) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= budget) if j > i}


def test_fingerprint():
    for text in [None, "", " \n", "One", "one two", "A b C d", "x " * 5000, "Ünï cödé wörds Hére"]:
        assert simhash.fingerprint(text) == signed(plain_fingerprint(text)), text


def test_links_are_all_pairs(spark):
    values = clusters(random.Random(1), 40, 6)
    rows = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for budget in (0, 1, 3, 5):
        found = {(r.a, r.b) for r in simhash.links(rows, budget).collect()}
        assert found == pairs_of(values, budget)


def test_crowded_buckets_are_dealt_again(spark, monkeypatch):
    rng = random.Random(2)
    values = sorted({(0xABCD << 48) | rng.getrandbits(20) for _ in range(600)})
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rows = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {(r.a, r.b) for r in simhash.links(rows, 3).collect()}
    assert found == pairs_of(values, 3)
    ids = dict(enumerate(values))
    expected = plain_classes(ids)
    reached = {r.node: r.root for r in simhash.components(simhash.links(rows, 3, forest=True)).collect()}
    groups = {}
    for i, v in ids.items():
        groups.setdefault(reached.get(signed(v), signed(v)), set()).add(expected[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))


def test_small_frontier(monkeypatch):
    rng = random.Random(3)
    values = np.array(clusters(rng, 30, 8), np.uint64)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    out = {(int(a), int(b)) for i, j in simhash.trie_pairs(np.zeros(len(values), np.int64), values, 64, 3) for a, b in zip(np.minimum(i, j), np.maximum(i, j))}
    assert out == {(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3) if j > i}


def test_components_of_a_long_chain(spark):
    rng = random.Random(4)
    names = rng.sample(range(10**6), 300)
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {n: min(names) for n in names if n != min(names)}


def test_query(spark, folder, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts}
    expected = plain_classes(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, folder).collect()}
    assert found == {i: (f"{p:016x}", expected[i]) for i, p in prints.items()}


def test_near_copies(docs_of):
    rng = random.Random(7)
    words = [f"w{rng.randint(0, 400)}" for _ in range(900)]
    rows = [(10 + k, " ".join(words[:k] + ["changed"] + words[k + 1 :])) for k in range(0, 900, 30)] + [(1, " ".join(rng.sample(words, 900)))]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    expected = plain_classes(prints)
    found = {r.doc_id: r.component_id for r in simhash.classes(docs_of(rows)).collect()}
    assert found == expected and len(set(expected.values())) < len(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.classes(odd_docs).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[3] == {(0, 1)}
    assert len(by[4]) == 1 and next(iter(by[5])) == (next(iter(by[4]))[0], 4)
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 4), (False, 6), (False, 7), (True, None)]
    assert simhash.classes(no_docs).count() == simhash.deduplicate(no_docs).count() == 0
