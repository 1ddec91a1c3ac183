"""Near-duplicates by SimHash fingerprints, linked by a binary trie self-join.

``fingerprints`` makes 64 bits from the hashes of a text's word shingles. ``links`` finds all
pairs of fingerprints that differ in few bits: two such fingerprints agree on one of
``budget + 1`` blocks of bits, so each is dealt to one bucket per block, and in each bucket two
tries over the other bits are walked together, from the root down, adding up differing bits and
leaving every pair of nodes whose sum is beyond the budget. A bucket with many fingerprints is
dealt again by blocks of the bits that are left, as often as needed: each time a quarter of these
bits goes, and a bucket can't hold more fingerprints than its bits can tell apart.

``components`` joins linked rows into classes. Links are reduced in each task to what connects
the same fingerprints; the rest is done by alternating star contractions on tables.

Defined results: a null or wordless text has fingerprint zero, and fingerprint zero is linked like
any other; copies share a fingerprint and so a class; rows without id take part, and a class of
such rows only has a null id; an empty table gives an empty table; columns that are not named here
are not touched, and temporary ones are dropped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.llm.common import stored

BITS = 64
SEED = 42
#: Fingerprints of one bucket that a single task joins; larger buckets are dealt again.
BUCKET = 4096
#: Fingerprints that a task joins at a time, and pairs of trie nodes that it holds at a time.
HELD = 100_000
FRONTIER = 500_000


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """Signed 64 bits; a bit is 1 if over half the shingles' hashes have it."""
    data = (text or "").encode("utf-8", "replace").lower().split()
    if not data:
        return 0
    shingles = [b" ".join(data)] if len(data) < width else map(b" ".join, zip(*(data[k:] for k in range(width))))
    n = max(1, len(data) - width + 1)
    hashes = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=seed), shingles), ">u8", n)
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n).view(">i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], at: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([fingerprint(t.as_py(), width) for t in batch.column(at)], pa.int64())
        columns = [c for k, c in enumerate(batch.columns) if k != at]
        names = [c for k, c in enumerate(batch.schema.names) if k != at]
        yield pa.RecordBatch.from_arrays([*columns, found], names=[*names, "out"])


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, out: str = "fingerprint") -> DataFrame:
    """All columns but the text, and the fingerprint as a long; a column of that name gives way."""
    df = df.select(*(c for c in df.columns if c != out or c == text))
    rest = [c for c in df.columns if c != text]
    at = df.columns.index(text)
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    schema = T.StructType([f for k, f in enumerate(plain.schema.fields) if k != at] + [T.StructField("out", T.LongType())])
    return plain.mapInArrow(functools.partial(_fingerprint_batches, at=at, width=width), schema).toDF(*rest, out)


def trie_pairs(bucket: np.ndarray, bits: np.ndarray, width: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs in the same bucket that differ in at most ``budget`` of ``width`` bits.

    Rows are sorted by bucket and bits, and distinct. A trie node is a run of rows with the same
    leading bits; a row of the frontier is two nodes of one depth and the bits in which they differ.
    """
    n = len(bits)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    starts, ends = starts[many], ends[many]
    stack = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    while stack:
        depth, a, a_end, b, b_end, spent = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(depth, *(x[half:] for x in (a, a_end, b, b_end, spent))), (depth, *(x[:half] for x in (a, a_end, b, b_end, spent)))]
            continue
        if not len(a):
            continue
        leaves = (a_end - a == 1) & (b_end - b == 1)
        if leaves.any():
            i, j = a[leaves], b[leaves]
            other = i != j
            i, j = i[other], j[other]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= budget
            yield i[near], j[near]
            a, a_end, b, b_end, spent = (x[~leaves] for x in (a, a_end, b, b_end, spent))
        if depth >= width or not len(a):
            continue
        shift = np.uint64(width - 1 - depth)
        # Where a node's rows turn from 0 to 1 in this bit: counts of ones up to each row give it.
        ones = np.r_[0, np.cumsum((bits >> shift) & np.uint64(1), dtype=np.int64)]
        a_cut, b_cut = a_end - (ones[a_end] - ones[a]), b_end - (ones[b_end] - ones[b])
        same = a == b
        parts = [
            (a, a_cut, b, b_cut, spent, None),
            (a_cut, a_end, b_cut, b_end, spent, None),
            (a, a_cut, b_cut, b_end, spent + 1, None),
            (a_cut, a_end, b, b_cut, spent + 1, ~same),
        ]
        kept = []
        for x, x_end, y, y_end, s, allowed in parts:
            live = (x_end > x) & (y_end > y) & (s <= budget) & ~((x == y) & (x_end - x == 1))
            if allowed is not None:
                live &= allowed
            kept.append(tuple(z[live] for z in (x, x_end, y, y_end, s)))
        stack.append((depth + 1, *(np.concatenate([k[c] for k in kept]) for c in range(5))))


def _forest(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each position is connected with."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        if np.array_equal(before, root):
            return root


def _join_block(fp: np.ndarray, bucket: np.ndarray, bits: np.ndarray, width: int, budget: int, forest: bool) -> pa.RecordBatch | None:
    order = np.lexsort((bits, bucket))
    fp, bucket, bits = fp[order], bucket[order], bits[order]
    i_held, j_held, held = [], [], 0
    for i, j in trie_pairs(bucket, bits, width, budget):
        i_held.append(i)
        j_held.append(j)
        held += len(i)
        if forest and held > FRONTIER:
            root = _forest(len(fp), np.concatenate(i_held), np.concatenate(j_held))
            i_held, j_held = [np.flatnonzero(root != np.arange(len(root)))], [root[root != np.arange(len(root))]]
            held = len(i_held[0])
    if not held:
        return None
    i, j = np.concatenate(i_held), np.concatenate(j_held)
    if forest:
        root = _forest(len(fp), i, j)
        i = np.flatnonzero(root != np.arange(len(root)))
        j = root[i]
    lo, hi = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
    return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])


def _join_batches(batches: Iterator[pa.RecordBatch], width: int, budget: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """Buckets come one after the other; as many whole ones as fit are joined at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def join(parts):
        fp, bucket, bits = (np.concatenate(x) for x in zip(*parts))
        out = _join_block(fp, bucket, bits.view(np.uint64), width, budget, forest)
        if out is not None:
            yield out

    for batch in batches:
        part = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(part[0]):
            continue
        if rows >= HELD:
            last = held[-1][1][-1]
            cut = int(np.argmax(part[1] != last)) if part[1][-1] != last or part[1][0] != last else len(part[1])
            held.append(tuple(x[:cut] for x in part))
            part = tuple(x[cut:] for x in part)
            if len(part[0]):
                yield from join(held)
                held, rows = [], 0
        if len(part[0]):
            held.append(part)
            rows += len(part[0])
    if held:
        yield from join(held)


def links(distinct: DataFrame, budget: int = 3, forest: bool = False) -> DataFrame:
    """Pairs (a, b) of the long column ``fp``, distinct in ``distinct``, that differ in at most ``budget`` bits.

    ``forest`` gives of each bucket only links that connect the same fingerprints.
    """
    if not budget:  # distinct fingerprints differ
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    blocks = budget + 1
    # left: the bits that are still to compare, at the low end; width: how many; bucket: what was agreed so far
    level = distinct.where("fp IS NOT NULL").select("fp", F.col("fp").alias("left"), F.lit(0).cast("long").alias("bucket"))
    width, found = BITS, None
    parallel = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        sizes = [width // blocks + (k < width % blocks) for k in range(blocks)]
        kinds, at = [], width
        for k, size in enumerate(sizes):
            at -= size
            mask = (1 << size) - 1
            own = F.shiftrightunsigned("left", at).bitwiseAND(F.lit(mask).cast("long"))
            high = F.shiftleft(F.shiftrightunsigned("left", at + size), at) if at + size < BITS else F.lit(0).cast("long")
            low = F.col("left").bitwiseAND(F.lit((1 << at) - 1).cast("long"))
            kinds.append(F.struct(F.xxhash64("bucket", F.lit(k), F.lit(width), own).alias("bucket"), high.bitwiseOR(low).alias("left")))
        dealt = level.select("fp", F.explode(F.array(*kinds)).alias("d")).select("fp", "d.bucket", "d.left")
        width -= min(sizes)  # where a larger block went, the leading bit stays 0
        counts = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        sized = stored(dealt.join(counts, "bucket"), "simhash-buckets")
        # Down to a bit for each block there are no more fingerprints than one task joins.
        most = BUCKET if width > blocks else 1 << blocks
        small = sized.where(F.col("n") <= most).select("fp", "bucket", "left").repartition(parallel, "bucket").sortWithinPartitions("bucket")
        pairs = small.mapInArrow(functools.partial(_join_batches, width=width, budget=budget, forest=forest), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        level = sized.where(F.col("n") > most).select("fp", "left", "bucket")
        if level.isEmpty():
            return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); the root is the smallest node of its class.

    Large-star and small-star steps alternate until nothing changes; each step is written.
    """
    links_ = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    state = None
    while True:
        both = links_.unionByName(links_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large.distinct(), "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links_ = stored(small.where("u <> v").distinct(), "cc-small")
        now = tuple(links_.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            return links_.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """(id, fingerprint long, component_id): the smallest id that links reach, the own one included."""
    marked = stored(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width=width, out="fp"), "simhash-docs")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    reached = stored(components(links(nodes.select("fp"), budget, forest=True)), "simhash-roots")
    rooted = nodes.join(reached, nodes.fp == reached.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = stored(rooted.join(ids, "root").select("fp", "component_id"), "simhash-classes")
    return marked.join(classed, "fp").select(F.col("doc_id").alias(doc_id), F.col("fp").alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """One document of each class, the one with the smallest id; rows without id all stay, and so do columns.

    Exactly repeated rows share an id; one of them stays.
    """
    return keep_first(df, classes(df, doc_id, text, width, budget), doc_id)


def keep_first(df: DataFrame, classed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows whose id is the ``component_id`` of its class, one for each id, and all rows without id."""
    first = classed.where(F.col(doc_id) == F.col("component_id"))
    kept = stored(first.groupBy(F.col(doc_id).alias("kept")).agg(F.count("*").alias("rows")), "simhash-kept")
    # All columns travel in one, so that their names clash with none here.
    whole = df.select(F.col(doc_id).alias("id"), F.struct(*df.columns).alias("d"))
    # The kept ids grow with the documents: merged at every size, never broadcast.
    with_id = whole.join(kept.select("kept").hint("merge"), F.col("id") == F.col("kept"), "left_semi")
    if not kept.where("rows > 1").isEmpty():
        with_id = with_id.dropDuplicates(["id"])
    return with_id.unionByName(whole.where("id IS NULL")).select("d.*")
