"""Near-duplicate vectors of equal label by binary codes of randomly rotated vectors.

Vectors are scaled to length one, rotated at random, and kept as the signs of their parts (one bit
each) with a correction factor, the inner product of a vector and its own signs. The signs of one
vector times the parts of another, divided by the factor, estimate their inner product without
bias, and its error has a known spread; a pair whose estimate is more than ``SIGMAS`` spreads below the threshold is
left. Every other pair is computed again on the original vectors in double precision, so a link is
never wrong. The other side of an estimate carries its parts in one byte each, rounded at random.

Which pairs are estimated: the signs of further rotations are cut into bands, and two vectors meet
where a band is equal. The length of a band follows from the rows of a label, so that about
``MEET`` vectors of no likeness share one, and the number of bands from that length, so that a pair at
the threshold meets nowhere with a chance of ``LOSS``; a nearer pair has less. A band that many
vectors share is cut into blocks, and each pair of blocks is one piece of work.

Copies are one vector with a weight. Many near copies of one vector are a ball: where a band is
crowded, the mean direction is taken, and vectors within half of the threshold's angle from it are
linked to each other by the triangle inequality. Their links are counted, not listed, and they
meet only vectors outside.

Defined results: rows whose vector is null, empty, zero or holds null or non-finite parts, rows
without label and rows without id have no links and are classes of their own (``kept`` is true
where the id is null); vectors of several lengths never link; exactly repeated rows (id, label,
vector) are one; an id with several vectors has a row for each; an empty table gives an empty one;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.ann import usable
from alphaloom.llm.common import in_runs, pieces, stored
from alphaloom.llm.simhash import components

THRESHOLD = 0.93
#: Bits of a code at least; shorter vectors are padded with zeros before they are rotated.
BITS = 64
#: Spreads of the estimate below the threshold at which a pair is left: one pair in 10^8 of those at the threshold.
SIGMAS = 5.7
#: Unlike vectors that share a band, and the chance that a pair at the threshold shares none.
MEET = 64
LOSS = 1e-4
#: Vectors of a crowded band, and of a block of it.
CROWD = 512


@functools.lru_cache(maxsize=32)
def rotation(dims: int, bits: int, seed: int) -> np.ndarray:
    """The first ``dims`` rows of a random orthogonal matrix; the same in every task and attempt."""
    q, r = np.linalg.qr(np.random.default_rng([seed, bits]).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dims]


def bits_of(dims: int) -> int:
    return max(BITS, -(-dims // 8) * 8)


def bands_of(rows: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits of a band, bands) for a label of so many distinct vectors."""
    length = min(32, max(4, math.ceil(math.log2(max(1, rows / MEET)))))
    agree = (1 - math.acos(threshold) / math.pi) ** length
    return length, math.ceil(math.log(LOSS) / math.log1p(-agree))


def spread(factor: np.ndarray, bits: int, threshold: float) -> np.ndarray:
    """Standard deviation of the estimate for a pair at the threshold, by the sign side's factor.

    Above the threshold it is smaller. The last term stands for parts rounded to a byte.
    """
    return np.sqrt((1 - threshold**2) * (1 / factor**2 - 1) / (bits - 1)) + 0.002


def _vectors(column: pa.ListArray, own: np.ndarray, dims: int) -> np.ndarray:
    return column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _scale_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors scaled by a power of two, which changes no digit, so that squares neither overflow nor vanish, and their lengths."""
    for batch in batches:
        vectors = batch.column(2)
        dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            x = _vectors(vectors, own, d)
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, d), pa.int32()), pa.array(x.ravel()))
            columns = [*(batch.column(k).take(pa.array(own)) for k in range(2)), pa.array(np.full(len(own), d, np.int32)), lists, pa.array(np.sqrt(np.einsum("nd,nd->n", x, x)))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "kind", "dims", "v", "long"])


def _code_batches(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Codes and bands; of a batch, vectors of one length and of labels as large go together."""
    for batch in batches:
        nodes, kinds, rows, dims, long = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        for d, n in sorted(set(zip(dims.tolist(), rows.tolist()))):
            own = np.flatnonzero((dims == d) & (rows == n))
            x = _vectors(batch.column(5), own, d) / long[own][:, None]
            bits = bits_of(d)
            y = x @ rotation(d, bits, 0)
            factor = np.abs(y).sum(axis=1) / math.sqrt(bits)
            scale = np.abs(y).max(axis=1) / 127
            # Rounding by a random threshold for each part, shifted for each vector.
            dither = (np.random.default_rng(bits).random(bits)[None, :] + (nodes[own] % 1_000_003 * 0.618033988749895 % 1)[:, None]) % 1
            parts = np.clip(np.floor(y / scale[:, None] + dither), -127, 127).astype(np.int8)
            signs = pa.array([s.tobytes() for s in np.packbits(y > 0, axis=1)], pa.binary())
            fixed = [pa.array(nodes[own]), pa.array(kinds[own]), pa.array(np.full(len(own), d, np.int32))]
            code = [signs, pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(scale), pa.array(factor)]
            length, bands = bands_of(n, threshold)
            each = bits // length
            for band in range(bands):
                if band % each == 0:
                    more = (x @ rotation(d, bits, 1 + band // each)) > 0
                at = band % each * length
                key = (more[:, at : at + length] * (1 << np.arange(length, dtype=np.int64))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.full(len(own), band, np.int32)), pa.array(key), *code], names=NAMES)


CODES = "node long, kind long, dims int, band int, key long, signs binary, parts binary, scale double, factor double"
NAMES = [c.split()[0] for c in CODES.split(", ")]
PLACE = ["kind", "dims", "band", "key"]
CODE = ["node", "ball", "signs", "parts", "scale", "factor"]


def _packed(column: pa.BinaryArray, kind: type) -> np.ndarray:
    """Binary values of one length as rows of an array."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), -1)


def undecided(left: pa.RecordBatch, right: pa.RecordBatch, threshold: float) -> np.ndarray:
    """Whether a pair's estimates, one by either side's signs, leave it open that it reaches the threshold."""

    def side(batch):
        signs = np.unpackbits(_packed(batch["signs"], np.uint8), axis=1).astype(np.float32) * 2 - 1
        parts = _packed(batch["parts"], np.int8) * batch["scale"].to_numpy().astype(np.float32)[:, None]
        factor = batch["factor"].to_numpy()
        bits = signs.shape[1]
        return signs / (factor * math.sqrt(bits)).astype(np.float32)[:, None], parts, (SIGMAS * spread(factor, bits, threshold)).astype(np.float32)

    (s, p, e), (t, q, g) = side(left), side(right)
    return (s @ q.T + e[:, None] >= threshold) & (p @ t.T + g[None, :] >= threshold)


def _meet(rows: pa.RecordBatch, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Undecided pairs of one piece of work: within its block, or between its two blocks."""
    sides = rows["side"].to_numpy(zero_copy_only=False)
    if sides.any():
        left, right = (rows.filter(pa.array(sides == k)) for k in (0, 1))
    else:
        left = right = rows
    mask = undecided(left, right, threshold)
    if left is right:
        mask = np.triu(mask, 1)
    ball, other = left["ball"].to_numpy(), right["ball"].to_numpy()
    i, j = np.nonzero(mask & ((ball[:, None] != other[None, :]) | (ball < 0)[:, None]))
    return left["node"].to_numpy()[i], right["node"].to_numpy()[j]


def _meet_batches(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for rows, runs in in_runs(batches, "work"):
        found = [_meet(rows.slice(a, n), threshold) for a, n in runs if n > 1]
        if any(len(a) for a, _ in found):
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _dot(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def _balls(vectors: DataFrame, banded: DataFrame, threshold: float) -> DataFrame:
    """(node, ball): members of crowded bands that lie within half of the threshold's angle from one direction."""
    crowded = stored(banded.groupBy(*PLACE).agg(F.count("*").alias("crowd")).where(F.col("crowd") > CROWD), "dedup-crowds")
    if crowded.isEmpty():
        return vectors.sparkSession.createDataFrame([], "node long, ball long")
    # A vector belongs to the most crowded of its bands. Balls have numbers from 0 on.
    ball = F.xxhash64(*PLACE).bitwiseAND(F.lit(2**63 - 1))
    home = banded.select("node", *PLACE).join(crowded, PLACE).groupBy("node").agg(F.max(F.struct("crowd", ball.alias("ball"))).alias("home"))
    members = stored(vectors.join(home.select("node", "home.ball"), "node").select("node", "ball", "v", "long"), "dedup-homes")
    near = math.cos(math.acos(threshold) / 2) + 1e-9
    inside = members
    # The second mean leaves out what the first one shows to be far.
    for bound in (0.5, near):
        part = inside.select("ball", "long", F.posexplode("v").alias("at", "x")).groupBy("ball", "at").agg(F.sum(F.col("x") / F.col("long")).alias("x"))
        centre = part.groupBy("ball").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("centre"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("reach"))
        inside = members.join(centre.where("reach > 0"), "ball").where(_dot("v", "centre") >= bound * F.col("long") * F.col("reach"))
        inside = stored(inside.select("node", "ball", "v", "long"), "dedup-balls")
    return inside.select("node", "ball")


def links(nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((a, b), (node, ball)): linked pairs of nodes, and members of balls, all of which are linked.

    ``nodes`` has (node long, distinct; kind long; vector array<double>, usable). A pair inside a
    ball is not among the pairs.
    """
    vectors = nodes.select("node", "kind", "vector").mapInArrow(_scale_batches, "node long, kind long, dims int, v array<double>, long double")
    vectors = stored(vectors, "dedup-vectors")
    counts = vectors.groupBy("kind", "dims").agg(F.count("*").alias("rows"))
    coded = vectors.join(counts, ["kind", "dims"]).select("node", "kind", "rows", "dims", "long", "v")
    banded = stored(coded.mapInArrow(functools.partial(_code_batches, threshold=threshold), CODES), "dedup-bands")
    balls = stored(_balls(vectors, banded, threshold), "dedup-balls")
    parallel = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = banded.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", F.lit(-1).cast("long")))
    work = pieces(marked, PLACE, CODE, CROWD).repartition(parallel, "work").sortWithinPartitions("work")
    pairs = work.mapInArrow(functools.partial(_meet_batches, threshold=threshold), "a long, b long").distinct()
    end = lambda n: vectors.select(F.col("node").alias(n), F.col("v").alias(f"v{n}"), F.col("long").alias(f"long{n}"))
    found = pairs.join(end("a"), "a").join(end("b"), "b")
    exact = _dot("va", "vb") / (F.col("longa") * F.col("longb"))
    return stored(found.where(exact >= threshold).select("a", "b"), "dedup-links"), balls


def classes(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector."""
    own = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    fits = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False))
    # Two hashes stand for label and vector: 128 bits.
    own = own.select("vec_id", "vector", F.xxhash64("label").alias("kind"), F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit("second"), "vector", "label").alias("h2"), fits.alias("fits"))
    rows = stored(own.select("vec_id", "h1", "h2", "fits").distinct(), "dedup-rows")
    weights = rows.where("fits").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    grouped = own.where("fits").groupBy("h1", "h2").agg(F.first("kind").alias("kind"), F.first("vector").alias("vector"))
    # Numbers are given once and written: no later attempt sees others.
    nodes = stored(grouped.join(weights, ["h1", "h2"]).withColumn("node", F.monotonically_increasing_id()), "dedup-nodes")
    pairs, balls = links(nodes, threshold)
    weighed = balls.join(nodes.select("node", "weight"), "node")
    totals = weighed.groupBy("ball").agg(F.sum("weight").alias("all"), F.min("node").alias("root"))
    in_ball = stored(weighed.join(totals, "ball").select("node", "root", (F.col("all") - F.col("weight")).alias("links")), "dedup-weighed")
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    counted = both.join(nodes.select(F.col("node").alias("other"), F.col("weight").alias("links")), "other").select("node", "links")
    counted = counted.unionByName(in_ball.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    edges = pairs.unionByName(in_ball.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    rooted = nodes.select("h1", "h2", "node", "least", "weight").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = rooted.join(ids, "root").join(counted, "node", "left")
    classed = classed.select("h1", "h2", F.lit(True).alias("fits"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    joined = rows.join(stored(classed, "dedup-classes"), ["h1", "h2", "fits"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE rows AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
used AS (
  SELECT * FROM rows WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v) AND len(list_filter(v, lambda x: x <> 0)) > 0),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM used a JOIN used b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM rows UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM linked GROUP BY a)
SELECT rows.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, rows.vec_id = component_id AS kept
FROM rows LEFT JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
