"""Byte-level BPE encoding and decoding on a contiguous rank array.

A word keeps its part boundaries and, beside them, the merge rank of each two adjacent parts. The
smallest rank is found by a scan, the boundary inside that pair is deleted, and the ranks on both
sides of it are refreshed, until no pair can merge. Words above ``SHORT`` bytes take the same
merges in the same order from a heap, because a scan for each merge is quadratic.

``round_trip`` does both in one pass. All keep all columns, but for one with the name of the new column. A null text has no tokens, as the empty one; null ids
decode to the empty text. Special tokens inside a text become their own id. Repeated rows are
encoded alike. Very long texts are encoded whole, one text at a time.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT = 400
#: Bytes that each of the two generations of a Python worker's cache may hold, and what an entry takes
#: besides its characters and ids: its place in the table and the heads of both objects.
CACHE_BYTES = 72_000_000
ENTRY = 190
#: Rows that are encoded or decoded at a time.
ROWS = 500

#: White space beyond the six ASCII characters; texts that hold any are split as a whole.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_CHUNK = re.compile(r" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
#: Fixed value: the public pattern of byte-level BPE that parts a text into words.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Recent(dict):
    """Answers by key, made when missing; of two generations the older goes when the newer is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= SHORT:
            size = ENTRY + len(key) + len(found)
            if self.held + size > CACHE_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = found
            self.held += size
        return found


class Codec:
    """Tables of one vocabulary file, and what a worker has encoded lately."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        chars = _byte_of_char()
        raw = lambda token: bytes(chars[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        pairs = [(raw(a), raw(b)) for a, b in pairs]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.joined = [self.ids[a + b] for a, b in pairs]
        self.rank_of_ids = {self.ids[a] << 32 | self.ids[b]: k for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Ids of chunks and of the words in them, by the same text: most chunks are one word.
        self.pieces = Recent(self._piece)

    def merge(self, word: bytes) -> list[bytes]:
        """The parts of a word that no merge joins any more."""
        if len(word) > SHORT:
            return self._merge_long(word)
        bounds, none, rank, joined = list(range(len(word) + 1)), len(self.joined), self.rank_of_ids.get, self.joined
        parts = [self.byte_ids[b] for b in word]
        ranks = [rank(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i] = joined[least]
            del bounds[i + 1], parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], none)
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _merge_long(self, word: bytes) -> list[bytes]:
        n, of_ids, joined = len(word), self.rank_of_ids.get, self.joined
        part = [self.byte_ids[b] for b in word]
        rank = lambda i, j: of_ids(part[i] << 32 | part[j])
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\x01") * n
        while heap:
            least, i, middle, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != middle or middle >= n or not alive[middle] or end[middle] != stop:
                continue
            alive[middle], end[i], part[i] = 0, stop, joined[least]
            if stop < n:
                before[stop] = i
                if (r := rank(i, stop)) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (j := before[i]) >= 0 and (r := rank(j, i)) is not None:
                heapq.heappush(heap, (r, j, i, stop))
        return [word[i : end[i]] for i in range(n) if alive[i]]

    def _piece(self, piece: str) -> bytes:
        words = _WORDS.findall(piece)
        if len(words) > 1:
            return b"".join(map(self.pieces.__getitem__, words))
        return array("i", [self.ids[p] for p in self.merge(piece.encode())]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as packed 32-bit integers."""
        if not text:
            return b""
        if self.special_pattern and any(s in text for s in self.special):
            pieces = self.special_pattern.split(text)
            return b"".join(array("i", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in pieces)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _RARE_SPACE.search(text):
            return b"".join(map(self.pieces.__getitem__, _WORDS.findall(text)))
        return b"".join(map(self.pieces.__getitem__, _CHUNK.findall(text)))

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(data: bytes) -> Codec:
    return Codec(data)


def _with_column(batch: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _lists(packed: list[bytes]) -> pa.ListArray:
    """Packed 32-bit integers as a column of lists."""
    lengths = pa.array([0, *(len(p) // 4 for p in packed)], pa.int64())
    offsets = pa.compute.cumulative_sum(lengths).cast(pa.int32())
    values = pa.Array.from_buffers(pa.int32(), offsets[-1].as_py(), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(offsets, values)


def _encode_batches(batches: Iterator[pa.RecordBatch], data: bytes, at: int, name: str) -> Iterator[pa.RecordBatch]:
    own = codec(data)
    for batch in _slices(batches):
        yield _with_column(batch, _lists([own.encode(t) for t in batch.column(at).to_pylist()]), name)


def _both_batches(batches: Iterator[pa.RecordBatch], data: bytes, at: int, name: str) -> Iterator[pa.RecordBatch]:
    """Ids and their text in one pass: the ids don't leave the worker in between."""
    own = codec(data)
    for batch in _slices(batches):
        packed = [own.encode(t) for t in batch.column(at).to_pylist()]
        texts = pa.array([own.decode(array("i", p)) for p in packed], pa.string())
        yield _with_column(batch, pa.StructArray.from_arrays([_lists(packed), texts], names=["ids", "text"]), name)


def _decode_batches(batches: Iterator[pa.RecordBatch], data: bytes, at: int, name: str) -> Iterator[pa.RecordBatch]:
    own = codec(data)
    for batch in _slices(batches):
        ids = batch.column(at)
        texts = []
        for k in range(len(ids)):
            one = ids[k].values
            texts.append(own.decode(one.to_numpy(zero_copy_only=False).tolist() if one is not None else ()))
        yield _with_column(batch, pa.array(texts, pa.string()), name)


def _positional(df: DataFrame, fn, path: str, column: str, kind: T.DataType) -> tuple[DataFrame, dict[str, Column]]:
    """The mapped rows with their result as ``out``, and the columns by name: they go through by position, so that any names do."""
    with open(path, "rb") as f:
        data = f.read()
    at = df.columns.index(column)
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    schema = T.StructType([*plain.schema.fields, T.StructField("out", kind)])
    mapped = plain.mapInArrow(functools.partial(fn, data=data, at=at, name="out"), schema)
    return mapped, {c: F.col(f"c{k}") for k, c in enumerate(df.columns)}


def _mapped(df: DataFrame, fn, path: str, column: str, out: str, kind: T.DataType) -> DataFrame:
    """A column that has the new name gives way."""
    mapped, kept = _positional(df, fn, path, column, kind)
    return mapped.select(*(c.alias(n) for n, c in kept.items() if n != out), F.col("out").alias(out))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns and the token ids of ``text`` by the vocabulary file at ``path``."""
    return _mapped(df, _encode_batches, path, text, out, T.ArrayType(T.IntegerType()))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the text that the ids stand for, special tokens included."""
    return _mapped(df, _decode_batches, path, ids, out, T.StringType())


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns, the token ids of ``text`` and the text that these ids stand for, made in one pass."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])
    mapped, kept = _positional(df, _both_batches, path, text, kind)
    kept = [c.alias(n) for n, c in kept.items() if n not in (ids, decoded)]
    return mapped.select(*kept, F.col("out.ids").alias(ids), F.col("out.text").alias(decoded))
