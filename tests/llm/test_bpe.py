"""Encoding against the tokenizers library; decoding by round trip."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from alphaloom.llm import bpe
from alphaloom.llm.queries import QUERIES, vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def codec():
    with open(vocabulary(), "rb") as f:
        return bpe.Codec(f.read())


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), np.int32).tolist()


def test_random_texts(codec, library):
    rng = random.Random(5)
    letters = "aZé ñ\n\t  \r'sdlv1²½Ⅷ٣\x1c\x85　漢字😀_-.!​́\x00ßʼll re᠎﻿"
    for k in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 16))) + "<|endoftext|>a" * (k % 40 == 0)
        found = ids_of(codec, text)
        assert found == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(found) == library.decode(found, skip_special_tokens=False)


def test_long_words_merge_alike(codec, library):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdehr") for _ in range(20_000))
    assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids
    word = text[: bpe.SHORT].encode()
    assert codec.merge(word) == codec._merge_long(word)


def test_cut_tokens_decode_to_marks(codec, library):
    whole = ids_of(codec, "漢字😀")
    for k in range(len(whole)):
        assert codec.decode(whole[:k]) == library.decode(whole[:k], skip_special_tokens=False)


def test_query(spark, folder, texts, library):
    found = {r.doc_id: r for r in QUERIES["op4_bpe"](spark, folder).collect()}
    assert len(found) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = found[doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_odd_rows(odd_docs, no_docs, codec):
    back = bpe.decode(bpe.encode(odd_docs, vocabulary()), vocabulary())
    assert back.columns == [c for c in odd_docs.columns if c != "ids"] + ["ids", "decoded"]
    rows = back.collect()
    assert len(rows) == 9
    assert all(r.decoded == (r.text or "") and list(r.ids) == ids_of(codec, r.text) for r in rows)
    assert bpe.decode(bpe.encode(no_docs, vocabulary()), vocabulary()).count() == 0
    both = bpe.round_trip(odd_docs, vocabulary())
    assert both.columns == back.columns and sorted(both.collect(), key=str) == sorted(rows, key=str)
    assert bpe.round_trip(no_docs, vocabulary()).count() == 0


def test_cache_is_bounded_in_bytes(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    codec.pieces.clear()
    codec.pieces.old, codec.pieces.held = {}, 0
    rng = random.Random(8)
    for _ in range(50):
        text = " ".join("".join(rng.choice("abcdé,'") for _ in range(rng.randint(1, 12))) for _ in range(40))
        assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids
        assert sum(bpe.ENTRY + len(k) + len(v) for k, v in codec.pieces.items()) <= 3000


def test_null_ids(spark):
    rows = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(rows, vocabulary()).collect()] == ["", ""]
