"""Classes of similar shingle sets against all pairs, and planted pairs at 0.8 to 0.95."""

import itertools
import random

import corpus_pipeline
from alphaloom.llm import shingles


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_roots(rows):
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def planted(rng, pairs=120):
    rows = []
    for k in range(pairs):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
        copy = list(words)
        for at in range(10, 10 + 20 * (k % 5), 20):
            copy[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    return rows


def test_pairs_from_the_threshold_on_are_linked(docs_of):
    rows = planted(random.Random(1))
    found = {r.doc_id: r.component_id for r in shingles.classes(docs_of(rows)).collect()}
    assert found == plain_roots(rows)
    near = [similarity(plain_set(a[1]), plain_set(b[1])) for a, b in zip(rows[::2], rows[1::2])]
    assert min(near) >= 0.8 and sum(s <= 0.85 for s in near) >= 20 and sum(s < 1 for s in near) >= 90


def test_stage_drops_them(spark, docs_of):
    rows = planted(random.Random(2))
    kept = corpus_pipeline.without_near_copies(spark, docs_of(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_roots(rows).values()))


def test_less_similar_texts_stay(docs_of):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join("x" if k % 20 == 10 and k < 160 else w for k, w in enumerate(words))), (3, " ".join(rng.sample(words, 200)))]
    assert similarity(plain_set(rows[0][1]), plain_set(rows[1][1])) < 0.8
    assert {r.doc_id: r.component_id for r in shingles.classes(docs_of(rows)).collect()} == {1: 1, 2: 2, 3: 3}


def test_crowded_buckets(docs_of):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(f"v{k}" if at in edits else w for at, w in enumerate(words))) for k in range(80) for edits in [set(rng.sample(range(300), 2))]]
    found = {r.doc_id: r.component_id for r in shingles.classes(docs_of(rows)).collect()}
    assert found == plain_roots(rows) and len(set(found.values())) == 1


def families(rng, count, own=4, words=300, edits=3):
    """Pairs of texts in one template: a family has a few words of its own, each of its texts some edits more."""
    template = [f"t{k}" for k in range(words)]
    rows = []
    for family in range(count):
        base = list(template)
        for k in rng.sample(range(words), own):
            base[k] = f"f{family}"
        for _ in range(2):
            copy = list(base)
            for k in rng.sample(range(words), edits):
                copy[k] = f"e{len(rows)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_a_crowd_in_one_template_loses_no_link(docs_of):
    """Texts of different families are less similar than 0.8 mostly, and all share buckets."""
    for own, count in ((4, 300), (5, 150)):
        rows = families(random.Random(own), count, own)
        found = {r.doc_id: r.component_id for r in shingles.classes(docs_of(rows)).collect()}
        assert found == plain_roots(rows)


def test_blocks_of_a_crowd(docs_of, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 20)
    rows = families(random.Random(9), 80, 4)
    found = {r.doc_id: r.component_id for r in shingles.classes(docs_of(rows)).collect()}
    assert found == plain_roots(rows)


def test_odd_rows(odd_docs, no_docs):
    kept = shingles.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 4), (False, 6), (False, 7), (True, None)]
    assert shingles.classes(odd_docs).count() == 9
    assert shingles.classes(no_docs).count() == shingles.deduplicate(no_docs).count() == 0
