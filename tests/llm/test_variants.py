"""Spelling variants against plain edit distances over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from alphaloom.llm import variants
from alphaloom.llm.queries import QUERIES

LETTERS = "abcdeéÿ÷"


def plain_words(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain_forms(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if v != w and one_edit(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = [n, len(near), best if best and words[best] >= 5 * n else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row += [words.get(row[2]), root]
    return {w: tuple(r) for w, r in out.items()}


def as_plain(found):
    rows = found.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def random_words(rng, size):
    words = set()
    while len(words) < size:
        w = "".join(rng.choice(LETTERS) for _ in range(rng.randint(6, 9)))
        for _ in range(4):
            words.add(w)
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :] if len(w) > 6 else w, w[:k] + rng.choice(LETTERS) + w[k:], w[:k] + rng.choice(LETTERS) + w[k + 1 :]])
    return sorted(words)


@pytest.mark.parametrize("crowd", [200, 3])
def test_neighbours_are_all_pairs_one_edit_apart(spark, monkeypatch, crowd):
    monkeypatch.setattr(variants, "CROWD", crowd)
    rng = random.Random(3)
    words = random_words(rng, 600)
    found = variants.neighbours(spark.createDataFrame([(w,) for w in words], "word string"))
    pairs = [(r.word, r.near) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def test_letters_that_many_words_share(spark, monkeypatch):
    monkeypatch.setattr(variants, "CROWD", 10)
    words = sorted({"".join(random.Random(k).sample("abcdefg", 7)) for k in range(400)})
    words += [w[:6] for w in words]
    found = variants.neighbours(spark.createDataFrame([(w,) for w in set(words)], "word string"))
    assert {(r.word, r.near) for r in found.collect()} == {(a, b) for a in set(words) for b in set(words) if a != b and one_edit(a, b)}


def test_forms_and_roots(spark):
    rng = random.Random(5)
    words = {w: rng.choice([5, 6, 25, 30, 125, 150, 625, 5000]) for w in random_words(rng, 400)}
    words |= {"aaaaaa": 5, "aaaaaab": 25, "aaaaabb": 125, "aaaabbb": 625, "aaabbbb": 3125, "zzzzzz": 5, "zzzzza": 25, "zzzzzb": 25}
    found = as_plain(variants.forms(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert found == plain_forms(words)
    assert found["aaaaaa"][4] == "aaabbbb" and found["zzzzzz"][2] == "zzzzza"


def test_query_on_documents(spark, folder, texts):
    expected = plain_words(texts)
    found = as_plain(QUERIES["op13_variants"](spark, folder))
    assert {w: r[0] for w, r in found.items()} == expected and len(found) > 100
    assert found == plain_forms(expected)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()] + [(k, "Élÿsée÷x HELLOWORLD helloworld hell0world") for k in (None, 1, 1, 2, 3, 4)]
    df = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], "doc_id long, text string, word string, n int, signature string")
    expected = plain_words(rows)
    assert as_plain(variants.group(df)) == plain_forms(expected) and "helloworld" in expected
    assert variants.group(no_docs).count() == 0
