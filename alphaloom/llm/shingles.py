"""Near-duplicates by fingerprints and minima of word shingles, checked exactly.

Two texts are linked if the sets of their five-word shingles have a similarity of at least 0.8.
Texts with the same set are one node. Candidates come from two sides: the trie join of 64-bit
fingerprints of the sets finds those that differ in up to ``BUDGET`` bits, and MinHash bands those
beyond: a pair with similarity s agrees on one of ``BANDS`` bands of ``ROWS`` minima with the chance
``1 - (1 - s ** ROWS) ** BANDS``, 0.9999 at 0.8. Every candidate is checked on the sets themselves,
so no link has less than the asked similarity.

A bucket of few nodes gives all its pairs. Of a crowded one, the pairs with two of its nodes are
checked first: the one that shares buckets with the most rows, which is the one that the others
are copies of, and one by checksum. Where that leaves nodes in different classes, those outside
the bucket's largest class meet all others of the bucket, in blocks, by a longer row of minima
(``SLOTS``); a pair is left if these put it five deviations below the similarity, and is checked
on the sets otherwise, unless its classes are one by then. A block gives only links that connect
classes, so pairs grow with the rows, and a crowd of different texts loses none.

Defined results: a text of fewer words than a shingle is one shingle; null and wordless texts have
the empty set and are one class; rows without id take part, and a class of such rows only has a
null id; an empty table gives an empty table; columns that are not named here are not touched.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm import simhash
from alphaloom.llm.common import in_runs, pieces, row_key, stored

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Bits in which fingerprints of candidates differ at most.
BUDGET = 5
#: Nodes of a bucket up to which all pairs are candidates, and nodes of a block of a larger one.
SMALL = 16
BLOCK = 512
#: Minima, of a byte each, that estimate the similarity of nodes in crowded buckets.
SLOTS = 512
#: Shingles whose minima are taken at a time.
HELD = 4096
_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
SLOT_FACTORS = _RNG.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLOT_OFFSETS = _RNG.integers(0, 2**63, SLOTS, dtype=np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    data = (text or "").encode("utf-8", "replace").lower().split()
    if not data:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(data)] if len(data) < width else map(b" ".join, zip(*(data[k:] for k in range(width))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, max(1, len(data) - width + 1)))


def minima(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return functools.reduce(np.minimum, (((hashes[k : k + HELD, None] * factors + offsets) >> np.uint64(32)).min(axis=0) for k in range(0, len(hashes), HELD)))


def slots(hashes: np.ndarray) -> bytes:
    """A byte of each of many minima; equal with the chance of the similarity, or by chance one time in 256."""
    return minima(hashes, SLOT_FACTORS, SLOT_OFFSETS).astype(np.uint8).tobytes() if len(hashes) else bytes(SLOTS)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64 bits; a bit is 1 if over half the set's hashes have it."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima; none for the empty set."""
    if not len(hashes):
        return []
    least = minima(hashes, FACTORS, OFFSETS)
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) - (1 << 63) for b in range(BANDS)]


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
        keys = pa.array([_key(s) for s in sets], pa.int64())
        prints = pa.array([fingerprint(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), keys, prints, pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["row_key", "node", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["node", "hashes"])


def _slot_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
        hashes = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([slots(s) for s in sets], pa.binary()), hashes], names=["node", "slots", "hashes"])


def _linked(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets are at least so similar."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared)


def _meet(part: pa.RecordBatch, least: float, similarity: float) -> Iterator[tuple[int, int]]:
    """Links of one piece of work that connect classes: pairs whose slots don't rule them out are checked, nearest first, until their classes are one."""
    node, root, side = (part[c].to_numpy(zero_copy_only=False) for c in ("node", "root", "side"))
    grid = np.frombuffer(b"".join(part["slots"].to_pylist()), np.uint8).reshape(len(node), SLOTS)
    sets: dict[int, np.ndarray] = {}

    def hashes(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = part["hashes"][k].values.to_numpy()
        return sets[k]

    _, now = np.unique(root, return_inverse=True)
    apart = side.any()
    other = np.flatnonzero(side == 1) if apart else np.arange(len(node))
    for i in np.flatnonzero(side == 0) if apart else range(len(node) - 1):
        mates = other if apart else other[i + 1 :]
        mates = mates[now[mates] != now[i]]
        near = (grid[mates] == grid[i]).mean(axis=1)
        order = np.argsort(-near, kind="stable")
        for j in mates[order[near[order] >= least]]:
            if now[i] != now[j] and _linked(hashes(i), hashes(j), similarity):
                now[now == now[j]] = now[i]
                yield int(min(node[i], node[j])), int(max(node[i], node[j]))


def _meet_batches(batches: Iterator[pa.RecordBatch], least: float, similarity: float) -> Iterator[pa.RecordBatch]:
    for rows, runs in in_runs(batches, "work"):
        found = [pair for start, n in runs if n > 1 for pair in _meet(rows.slice(start, n), least, similarity)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n): bands that several nodes share."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return stored(rows.join(counts.hint("merge"), "bucket"), "shingles-buckets")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes whose fingerprints are equal or near; of equal ones, each with the smallest."""
    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "shingles-prints")
    near = simhash.links(firsts.select("fp"), BUDGET, forest=True)
    end = lambda fp, out: firsts.select(F.col("fp").alias(fp), F.col("first").alias(out)).hint("merge")
    pairs = near.withColumnsRenamed({"a": "f", "b": "g"}).join(end("f", "a"), "f").join(end("g", "b"), "g").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    same = nodes.select("fp", "node").join(firsts.hint("merge"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return pairs.unionByName(same)


def _pairs(buckets: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of small buckets, and pairs with two nodes of crowded ones."""
    whole = buckets.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.collect_list("node").alias("x"))
    whole = whole.select("x", F.explode("x").alias("a")).select("a", F.explode("x").alias("b")).where("a < b")
    crowded = buckets.where(F.col("n") > SMALL)
    weight = crowded.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = crowded.join(weight.hint("merge"), "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("x"), F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node"))["node"].alias("y"))
    stars = crowded.select("bucket", "node").join(hubs.hint("merge"), "bucket").select("node", F.explode(F.array("x", "y")).alias("hub")).where("node <> hub")
    return whole.unionByName(stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")))


def _texts_of(nodes: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes; only their texts are read again, and repeated rows share a key."""
    keyed = nodes.select("node", "row_key").join(wanted.select("node").distinct().hint("merge"), "node")
    return texts.join(keyed.hint("merge"), "row_key").select("node", "text").dropDuplicates(["node"])


def _checked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose sets are at least so similar."""
    pairs = stored(pairs.distinct(), "shingles-pairs")
    read = _texts_of(nodes, texts, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    sets = stored(read.mapInArrow(functools.partial(_sets, width=width), "node long, hashes array<long>"), "shingles-sets")
    of = lambda side: sets.select(F.col("node").alias(side), F.col("hashes").alias(f"{side}_set")).hint("merge")
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return stored(both.where(shared >= F.lit(similarity) * (F.size("a_set") + F.size("b_set") - shared)).select("a", "b"), "shingles-links")


def _unsettled(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, node, root, ball) of crowded buckets whose nodes are in several classes; ball is the largest of them, else -1."""
    roots = stored(simhash.components(found), "shingles-settled")
    crowded = buckets.where(F.col("n") > SMALL).select("bucket", "node")
    rooted = stored(crowded.join(roots.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "shingles-crowded")
    shares = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    top = shares.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("top"), F.count("*").alias("classes")).where("classes > 1")
    ball = F.when(F.col("root") == F.col("top"), F.col("root").bitwiseAND(F.lit(2**63 - 1))).otherwise(F.lit(-1).cast("long"))
    return stored(rooted.join(top.hint("merge"), "bucket").select("bucket", "node", "root", ball.alias("ball")), "shingles-unsettled")


def links(nodes: DataFrame, texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) that connect all nodes whose sets are at least so similar, from (node, row_key, fp, bands) and the rows' texts."""
    buckets = _buckets(nodes)
    found = _checked(_pairs(buckets).unionByName(_by_fingerprint(nodes)), nodes, texts, width, similarity)
    open_ = _unsettled(buckets, found)
    if open_.isEmpty():
        return found
    sketched = _texts_of(nodes, texts, open_).mapInArrow(functools.partial(_slot_batches, width=width), "node long, slots binary, hashes array<long>")
    carried = open_.join(stored(sketched, "shingles-slots").hint("merge"), "node")
    parallel = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = pieces(carried, ["bucket"], ["node", "root", "slots", "hashes"], BLOCK).repartition(parallel, "work").sortWithinPartitions("work")
    # Five deviations below; slots that agree by chance only raise the estimate.
    least = similarity - 5 * math.sqrt(similarity * (1 - similarity) / SLOTS)
    more = work.mapInArrow(functools.partial(_meet_batches, least=least, similarity=similarity), "a long, b long")
    return found.unionByName(stored(more.distinct(), "shingles-more"))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id): the smallest id that links reach, the own one included."""
    rows = df.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    sketched = rows.select("row_key", "text").mapInArrow(functools.partial(_sketches, width=width), "row_key string, node long, fp long, bands array<long>")
    sketched = stored(sketched, "shingles-sketches")
    nodes = stored(sketched.groupBy("node").agg(F.min_by(F.struct("row_key", "fp", "bands"), "row_key").alias("s")).select("node", "s.*"), "shingles-nodes")
    reached = stored(simhash.components(links(nodes, rows.select("row_key", "text"), width, similarity)), "shingles-roots")
    marked = rows.select("doc_id", "row_key").join(sketched.select("row_key", "node").distinct().hint("merge"), "row_key")
    rooted = stored(marked.join(reached.hint("merge"), "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")), "shingles-rooted")
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(ids.hint("merge"), "root").select(F.col("doc_id").alias(doc_id), "component_id")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the smallest id; rows without id all stay, and so do columns."""
    return simhash.keep_first(df, classes(df, doc_id, text, width, similarity), doc_id)
