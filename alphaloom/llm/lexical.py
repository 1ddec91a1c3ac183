"""Ranked lexical search by the Best Position Algorithm.

``search`` ranks all documents for each item of a stated set of queries. A document's score for an
item is the sum over the item's terms, repeats included, of the term's impact in the document: an
integer of the term's weight, its occurrences and the document's length.

One pass over whole texts keeps, of each document, its length and the terms that some item asks
for. Then each task takes documents in shards of bounded size and sorts their postings into one list
a term, highest impact first. For an item, lists are read from the top in growing strides; a document
that turns up is looked up in all lists at once, and its place in each of them is marked as seen.
The best position of a list is the last before its first unseen place, so lookups move it beyond
what was read in turn. No unseen document can score above the impacts at the best positions
together, and the search of a shard stops when that sum is strictly below the lowest score kept;
an equal one could still win by its id. Scores kept from a task's earlier shards bound the later
ones. The best of all tasks are merged.

Items are taken in blocks of bounded text, so that a block's terms and counts fit the driver and
every task; each block is one pass.

Defined results: null and empty texts hold no term; a document without terms counts in nothing;
repeated rows are documents of their own; among equal scores smaller ids come first and null last;
repeated items (same id, same text) are one, and items without terms have no rows; rows of equal
id and different text are ranked one by one; ids of documents must be integers; empty tables give
an empty one; very long texts are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.llm.common import stored

#: Postings that a task holds at a time, places that each list is read by at first, bytes of a block of items.
SHARD = 2_000_000
STRIDE = 32
BLOCK_BYTES = 4_000_000

#: Lower-cased ASCII letters and digits stay, other ASCII is a gap; bytes above are parts of terms.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and all other characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def _posting_batches(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    number = vocabulary.get
    for batch in batches:
        lengths, offsets, found, counts = [], [0], [], []
        for text in batch.column(1):
            words = terms(text.as_py())
            own = Counter(filter(None, map(number, words)))
            lengths.append(len(words))
            found.extend(own)
            counts.extend(own.values())
            offsets.append(len(found))
        lists = (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (found, counts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])


def _count_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, of one task."""
    df = np.zeros(size + 1, np.int64)
    for batch in batches:
        df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size + 1)
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Best:
    """The best documents of one item so far: score, id, and whether the id is null."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a score must reach; -1 as long as there is room."""
        return int(self.scores[-1]) if len(self.scores) == self.top else -1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        fit = (scores > 0) & (scores >= self.least)
        if not fit.any():
            return
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores[fit]), (self.ids, ids[fit]), (self.nulls, nulls[fit])))
        order = np.lexsort((ids, nulls, -scores))[: self.top]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


class Shard:
    """Impact lists of some documents, and the way from a document to its places in all lists."""

    def __init__(self, ids, nulls, lengths, sizes, term, tf, weights: np.ndarray, documents: int, length: int):
        distinct, at = np.unique(lengths, return_inverse=True)
        # Plain integers: the product can pass 64 bits where the quotient doesn't.
        norm = np.array([75 + 25 * int(n) * documents // length for n in distinct], np.int64)[at]
        owner = np.repeat(np.arange(len(ids)), sizes)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[owner]))
        kept = impact > 0
        self.ids, self.nulls = ids, nulls
        self.term, self.impact, owner = term[kept], impact[kept], owner[kept]
        self.sizes = np.bincount(owner, minlength=len(ids))
        self.starts = np.cumsum(self.sizes) - self.sizes
        order = np.lexsort((-self.impact, self.term))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.list_impact, self.list_owner = self.impact[order], owner[order]
        self.list_size = np.bincount(self.term, minlength=len(weights))
        self.list_start = np.cumsum(self.list_size) - self.list_size
        self.seen, self.done = np.zeros(len(order), bool), np.zeros(len(ids), bool)
        self.asked = np.zeros(len(weights), np.int64)

    def search(self, asked: np.ndarray, repeats: np.ndarray, best: Best) -> int:
        """Add what the shard holds to ``best``; returns how many documents were looked up."""
        some = self.list_size[asked] > 0
        asked, repeats = asked[some], repeats[some]
        start, size = self.list_start[asked], self.list_size[asked]
        self.asked[asked] = repeats
        position, stride = np.zeros(len(asked), np.int64), STRIDE
        marked, looked_up = [], []
        while (position < size).any():
            turn = _ragged(start + position, np.minimum(stride, size - position))
            documents = np.unique(self.list_owner[turn[~self.seen[turn]]])
            if len(documents):
                each = _ragged(self.starts[documents], self.sizes[documents])
                share = self.asked[self.term[each]] * self.impact[each]
                scores = np.add.reduceat(share, np.cumsum(self.sizes[documents]) - self.sizes[documents])
                places = self.place[each[share > 0]]
                self.seen[places] = True
                marked.append(places)
                looked_up.append(documents)
                best.add(scores, self.ids[documents], self.nulls[documents])
            position = self._advance(start, size, position, 2 * stride)
            bound = int((repeats * np.where(position < size, self.list_impact[start + position - 1], 0)).sum())
            if bound < best.least:
                break
            stride *= 2
        self.asked[asked] = 0
        for places in marked:
            self.seen[places] = False
        return sum(map(len, looked_up))

    def _advance(self, start: np.ndarray, size: np.ndarray, position: np.ndarray, width: int) -> np.ndarray:
        """Best positions: how many places from each list's top are seen without a gap."""
        position = position.copy()
        live = np.flatnonzero(position < size)
        while len(live):
            steps = np.minimum(width, size[live] - position[live])
            grid = position[live][:, None] + np.arange(width)
            inside = np.arange(width) < steps[:, None]
            seen = np.zeros(grid.shape, bool)
            seen[inside] = self.seen[(start[live][:, None] + grid)[inside]]
            run = np.where(seen.all(axis=1), width, seen.argmin(axis=1))
            position[live] += np.minimum(run, steps)
            live = live[(run >= steps) & (position[live] < size[live])]
        return position


def _search_batches(batches: Iterator[pa.RecordBatch], queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, length: int, top: int, shard: int) -> Iterator[pa.RecordBatch]:
    best = [Best(top) for _ in queries]
    held, postings = [], 0

    def run() -> None:
        ids, nulls, lengths, sizes, term, tf = (np.concatenate(x) for x in zip(*held))
        part = Shard(ids, nulls, lengths, sizes, term, tf, weights, documents, length)
        for (asked, repeats), own in zip(queries, best):
            part.search(asked, repeats, own)
        held.clear()

    for batch in batches:
        ids, n, found, counts = batch.columns
        flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (found, counts)]
        sizes = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), sizes, *flat))
        postings += len(flat[0])
        if postings >= shard:
            run()
            postings = 0
    if held:
        run()
    item = np.repeat(np.arange(len(best)), [len(b.scores) for b in best]).astype(np.int32)
    joined = lambda part: np.concatenate([getattr(b, part) for b in best])
    if len(item):
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(joined("ids"), mask=joined("nulls")), pa.array(joined("scores"))], names=["item", "doc_id", "score"])


def _search_block(docs: DataFrame, texts: list[bytes | None], top: int, shard: int) -> DataFrame | None:
    """(item, doc_id, score) of the best documents of each task, item being a text's number."""
    asked = [Counter(terms(t)) for t in texts]
    # From 1 on; 0 stands for no term.
    vocabulary = {term: k for k, term in enumerate(sorted(set().union(*asked)), 1)}
    if not vocabulary:
        return None
    postings = docs.mapInArrow(functools.partial(_posting_batches, vocabulary=vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>")
    postings = stored(postings.where("n > 0"), "lexical-postings")
    documents, length = postings.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    some = postings.where(F.size("terms") > 0)
    counted = some.select("terms").mapInArrow(functools.partial(_count_batches, size=len(vocabulary)), "term int, df long")
    weights = np.zeros(len(vocabulary) + 1, np.int64)
    for term, df in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    queries = [(np.array([vocabulary[t] for t in own], np.int64), np.array(list(own.values()), np.int64)) for own in asked]
    find = functools.partial(_search_batches, queries=queries, weights=weights, documents=documents, length=length, top=top, shard=shard)
    return some.mapInArrow(find, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be an integer column")
    own = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text")).distinct()
    own = stored(own.withColumn("row", F.monotonically_increasing_id()), "lexical-items")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = None
    for block in range(blocks):
        part = own.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").collect()
        one = _search_block(rows, [None if r.text is None else bytes(r.text) for r in part], top, shard)
        if one is None:
            continue
        numbers = docs.sparkSession.createDataFrame([(k, r.row) for k, r in enumerate(part)], "item int, row long")
        one = one.join(numbers, "item").select("row", "doc_id", "score")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return own.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    by = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.join(own.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
norms AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // words) AS m FROM lengths, totals),
counts AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
asked AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
