"""The mix against a plain queue over all turns."""

import hashlib
import random
import re

import pytest

from alphaloom.llm import mixing


def plain_mix(rows, weights=(5, 2, 1), epochs=3):
    """{position: taken} and {source: target} by sorting every turn."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, open_, rest = {}, set(sources), sum(size)
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > epochs * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(epochs * total[s])
            rest -= epochs * total[s]
            open_.discard(s)
        if not open_:
            break
    place = [hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest() for i, *_ in rows]
    turns = []
    for s in sources:
        mine = sorted((k for k in range(len(rows)) if rows[k][2] == s), key=lambda k: place[k])
        for e in range(epochs):
            given = e * total[s]
            for k in mine:
                given += size[k]
                if size[k] and target[s]:
                    turns.append((given / target[s], place[k], e, k))
    taken, upto = [0] * len(rows), 0
    for _, _, _, k in sorted(turns):
        upto += size[k]
        if upto > sum(size):
            break
        taken[k] += size[k]
    return taken, target


def documents(n, seed, sources):
    rng = random.Random(seed)
    return [(k, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))), rng.choices(*sources)[0]) for k in range(n)]


@pytest.mark.parametrize("sources", [((["a", "b", "c", None]), [40, 5, 3, 1]), (["only"], [1]), ([f"s{k:02}" for k in range(30)], [30] + [1] * 29)])
def test_against_a_plain_queue(docs_of, sources, monkeypatch):
    monkeypatch.setattr(mixing, "SORTED_TURNS", 20)
    monkeypatch.setattr(mixing, "RANGES", 4)
    rows = documents(400, 3, sources)
    taken, target = plain_mix(rows)
    found = {r.doc_id: r for r in mixing.queue(docs_of(rows)).collect()}
    assert {k: r.taken for k, r in found.items()} == dict(enumerate(taken))
    for k, (_, _, s) in enumerate(rows):
        assert found[k].target == pytest.approx(target[s])


def test_sources_come_near_their_targets(docs_of):
    rows = documents(600, 4, (["x", "y", "z"], [10, 6, 2]))
    out = mixing.queue(docs_of(rows)).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    for r in out:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"]


def test_mixture_repeats_documents(docs_of):
    rows = documents(200, 5, (["x", "y", "z"], [10, 6, 2]))
    docs = docs_of(rows)
    uses = {r.doc_id: r.taken // r.size for r in mixing.queue(docs).where("taken > 0").collect()}
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == uses and max(uses.values()) <= 3


def test_reruns_agree(docs_of):
    docs = docs_of(documents(300, 6, (["x", None], [3, 1])))
    runs = [sorted((r.doc_id, r.taken) for r in mixing.queue(d).collect()) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.queue(odd_docs).collect()
    assert len(rows) == 9 and all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mixture(odd_docs).columns == odd_docs.columns
    assert mixing.mixture(odd_docs).count() > 0
    assert mixing.queue(no_docs).count() == mixing.mixture(no_docs).count() == 0
