"""Exact formats against Python's regular expressions; discovery and redaction on planted cases."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from alphaloom.llm import pii
from alphaloom.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]
            if fine():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def test_formats(docs_of):
    rng = random.Random(8)
    pieces = ["a", "Z9", "@", ".", "..", "-", "_", "%", "+", "+1 ", " (2) ", "255", "256", "0001", "1.2.3.4", "x@y.z", "ü", "漢", " ", "\n", "12 34", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (613) 555-8758", "99999999999"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for k in range(3000)]
    rows += [(3000, "1" * 30_000 + ".2.3.4"), (3001, "a" * 30_000), (3002, "1 " * 20_000), (3003, "a." * 10_000 + "@b.c"), (3004, "x@y.z_d@e.f and q@r@s.t")]
    found = {r.doc_id: r.base for r in pii.find(docs_of(rows)).select("doc_id", pii.written(F.col("base")).alias("base")).collect()}
    for doc_id, text in rows:
        assert found[doc_id] == ",".join(plain_spans(text)), text[:200]


def test_patterns_find_what_formats_miss(docs_of):
    rng = random.Random(9)
    rows = [(k, f"some words here, pay with card {card(rng)} today please") for k in range(60)]
    wrong = card(rng)
    wrong = wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
    rows += [(100, f"some words here, pay with card {wrong} today please"), (101, f"the number {wrong} is of no kind"), (102, "clean text of 2024 with 3 numbers, 12 and 7")]
    found = {r.doc_id: r for r in pii.find(docs_of(rows)).collect()}
    added = [s for s in found[100].spans if s not in found[100].base]
    text = rows[60][1]
    assert [(pii.KINDS[s.kind], text[s.start : s.end]) for s in added] == [("card", wrong)]
    assert not found[101].spans and not found[102].spans
    clean = {r.doc_id: r.text for r in pii.redact(docs_of(rows)).collect()}
    assert clean[100] == "some words here, pay with card [CARD] today please"
    assert clean[0] == clean[100] and clean[102] == rows[-1][1]


def added_of(found, rows):
    texts = dict(rows)
    return {r.doc_id: [(pii.KINDS[s.kind], texts[r.doc_id][s.start : s.end]) for s in r.spans if s not in r.base] for r in found if r.spans != r.base}


def test_words_find_formats_that_the_base_lacks(docs_of):
    rng = random.Random(11)
    n = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    rows = [(k, f"please call me on +1 {n(3)} {n(3)} {n(4)} today or so") for k in range(60)]
    rows += [(100 + k, f"just write to ab{k}@mail.example any day of it") for k in range(60)]
    rows += [(200, "please call me on 613.555.8758 today or so"), (201, "please call me on 0613-5558758 today or so"), (202, "just write to joe@localhost any day of it")]
    rows += [(203, "the part 613.555.8759 is of no kind"), (204, "please call me on 12 today or so")]
    found = pii.find(docs_of(rows)).collect()
    assert added_of(found, rows) == {200: [("phone", "613.555.8758")], 201: [("phone", "0613-5558758")], 202: [("email", "joe@localhost")]}


def test_found_shapes_prove_other_words(docs_of):
    rng = random.Random(12)
    n = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    known, new = lambda: f"+1 {n(3)} {n(3)} {n(4)}", lambda: f"{n(3)}.{n(3)}.{n(4)}"
    rows = [(k, f"phone on {known()} today") for k in range(200)] + [(300 + k, f"phone at {known()} now") for k in range(200)]
    rows += [(600 + k, f"phone on {new()} today") for k in range(8)] + [(700 + k, f"phone at {new()} now") for k in range(8)]
    rows += [(800, f"phone on {new()} now")]
    found = added_of(pii.find(docs_of(rows)).collect(), rows)
    assert sorted(found) == [*range(600, 608), *range(700, 708), 800]


def test_patterns_that_meet_other_kinds_find_nothing(docs_of):
    rng = random.Random(10)
    rows = [(k, f"number {card(rng)} here") for k in range(20)] + [(100 + k, f"number {rng.randint(10**15, 10**16 - 1)} here") for k in range(60)]
    found = pii.find(docs_of(rows)).collect()
    assert all(r.base == r.spans for r in found)


def test_query(spark, folder, texts):
    found = {r.doc_id: r for r in QUERIES["op2_pii"](spark, folder).collect()}
    assert len(found) == len(texts)
    for doc_id, text in texts:
        spans, r = plain_spans(text), found[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in spans) for k in pii.KINDS)
        assert set(spans) <= set(filter(None, r.spans.split(",")))


def test_overlaps_go_to_the_first(docs_of):
    text = "call +1 613 555 8758 or 4111 1111 1111 1111, a@b.cd"
    assert [r.text for r in pii.redact(docs_of([(1, text)])).collect()] == ["call [PHONE] or [CARD], [EMAIL]"]


def test_odd_rows(odd_docs, no_docs):
    rows = pii.find(odd_docs).collect()
    assert len(rows) == 9
    long = next(r for r in rows if r.doc_id == 6)
    assert [pii.KINDS[s.kind] for s in long.base] == ["email"]
    clean = pii.redact(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == 9
    assert {r.text for r in clean.collect() if r.doc_id in (1, 2)} == {None, ""}
    assert pii.find(no_docs).count() == pii.redact(no_docs).count() == 0
