"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Equal vectors are one node with its smallest ids, which lose no result, since a list never needs
more of them than its length and the query itself. Nodes are dealt to shards of bounded size. In a
shard, one more coordinate makes all vectors equally long, so that the largest inner product is
the smallest distance. Nodes enter the graph in doubling batches: a greedy beam search from the
shard's centre proposes neighbours, relaxed distance pruning keeps those that no kept neighbour
shadows, and the kept edges are added the other way round, pruned again where a node has too many.

Every shard's graph is stored as one packed row. It goes to one task for each ``SLICE`` of the
queries, and these follow it in blocks, each searched by beam search. The best of each shard are
scored again in double precision on the original vectors and merged.

Defined results: rows whose vector is null, empty, zero or holds null or non-finite parts take no
part, nor do rows without id; among vectors of several lengths a query meets those of its own
length; ties go to the smaller id; repeated rows (same id, same vector) are one; an id with
different vectors is a candidate by each and comes once, at its best; fewer candidates than asked
for give shorter lists; an empty table gives an empty one. The index holds every vector.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import stored

#: Nodes of a shard on average, edges of a node, beam widths, relaxation of the pruning.
SHARD = 16_384
DEGREE = 40
BUILD_BEAM, SEARCH_BEAM = 64, 96
ALPHA = 1.2
#: Queries that are searched together, those that one copy of a shard serves, and rows that enter the graph together at most.
BLOCK = 2048
SLICE = 65_536
BATCH = 1024
GRAPH = "shard string, dims int, start int, ids binary, sizes binary, vectors binary, edges binary"


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, not zero, all parts finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def _distances(points: np.ndarray, squares: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances, less the query's own square, of each query to its row of ids."""
    return squares[ids] - 2 * np.einsum("qd,qkd->qk", queries, points[ids])


def beam_search(points: np.ndarray, squares: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the beam of each query, nearest first; unused places are -1 and inf.

    All queries move together: each expands its nearest open node, until none has an open one. That
    ends, as a beam only gets nearer: a node that left it can't come back.
    """
    n = len(queries)
    ids = np.full((n, beam), -1, np.int64)
    near = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    ids[:, 0] = start
    near[:, 0] = _distances(points, squares, queries, np.full((n, 1), start))[:, 0]
    active = np.arange(n)
    while True:
        open_ = np.where(done[active] | (ids[active] < 0), np.inf, near[active])
        pick = open_.argmin(axis=1)
        live = np.isfinite(open_[np.arange(len(active)), pick])
        active, pick = active[live], pick[live]
        if not len(active):
            break
        done[active, pick] = True
        next_ = edges[ids[active, pick]]
        found = _distances(points, squares, queries[active], np.maximum(next_, 0)).astype(np.float32)
        held = ids[active]
        found[(next_ < 0) | (next_[:, :, None] == held[:, None, :]).any(axis=2)] = np.inf
        all_near = np.concatenate([near[active], found], axis=1)
        all_ids = np.concatenate([held, np.where(np.isfinite(found), next_, -1)], axis=1)
        all_done = np.concatenate([done[active], np.zeros(found.shape, bool)], axis=1)
        order = np.argpartition(all_near, beam - 1, axis=1)[:, :beam]
        near[active] = np.take_along_axis(all_near, order, axis=1)
        ids[active] = np.take_along_axis(all_ids, order, axis=1)
        done[active] = np.take_along_axis(all_done, order, axis=1)
    order = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(near, order, axis=1)


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Up to ``degree`` edges of each node in ``own`` from its row of candidates (-1: none).

    The nearest candidate is kept, and all that are clearly nearer to it than to the node go.
    """
    n, width = candidates.shape
    out = np.full((n, degree), -1, np.int64)
    for k in range(0, n, 512):
        mine, cand = own[k : k + 512], candidates[k : k + 512]
        rows = points[np.maximum(cand, 0)]
        apart = rows - points[mine][:, None, :]
        far = np.einsum("nkd,nkd->nk", apart, apart)
        order = np.argsort(cand, axis=1, kind="stable")
        sorted_ = np.take_along_axis(cand, order, axis=1)
        twice = np.zeros(cand.shape, bool)
        np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], axis=1)
        far[(cand < 0) | (cand == mine[:, None]) | twice] = np.inf
        squares = np.einsum("nkd,nkd->nk", rows, rows)
        at = np.arange(len(mine))
        for slot in range(degree):
            best = far.argmin(axis=1)
            some = np.isfinite(far[at, best])
            if not some.any():
                break
            out[k : k + 512][some, slot] = cand[at, best][some]
            kept = rows[at, best]
            between = squares + squares[at, best][:, None] - 2 * np.einsum("nkd,nd->nk", rows, kept)
            far[alpha * between <= far] = np.inf
            far[at, best] = np.inf
    return out


def build(points: np.ndarray) -> tuple[np.ndarray, int]:
    """(edges, start): edges as a row of node numbers for each node, -1 where there is none."""
    n = len(points)
    squares = np.einsum("nd,nd->n", points, points)
    centre = points.mean(axis=0)
    start = int(np.argmin(squares - 2 * points @ centre))
    edges = np.full((n, DEGREE), -1, np.int64)
    order = np.random.default_rng(n).permutation(n)
    order = np.r_[start, order[order != start]]
    done, size = 1, 1
    while done < n:
        batch = order[done : done + size]
        beam, _ = beam_search(points, squares, edges, start, points[batch], min(BUILD_BEAM, max(2, done)))
        # Nodes of a batch don't see each other; a few random ones of the batch join their candidates.
        mates = np.random.default_rng(done).choice(batch, (len(batch), 8))
        edges[batch] = robust_prune(points, batch, np.hstack([beam, mates]))
        source = np.repeat(batch, DEGREE)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, counts = np.unique(target, return_index=True, return_counts=True)
        for k in range(0, len(heads), 2048):
            nodes, c = heads[k : k + 2048], counts[k : k + 2048]
            extra = np.full((len(nodes), c.max()), -1, np.int64)
            row = np.repeat(np.arange(len(nodes)), c)
            begin = first[k]
            extra[row, np.arange(len(row)) - np.repeat(first[k : k + 2048] - begin, c)] = source[begin : begin + c.sum()]
            both = np.hstack([edges[nodes], extra])
            full = (both >= 0).sum(axis=1) > DEGREE
            if full.any():
                edges[nodes[full]] = robust_prune(points, nodes[full], both[full])
            if (~full).any():
                left = both[~full]
                left = np.take_along_axis(left, np.argsort(left < 0, axis=1, kind="stable"), axis=1)[:, :DEGREE]
                edges[nodes[~full]] = left
        done += len(batch)
        size = min(BATCH, 2 * size)
    return edges, start


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate that makes all rows as long as the longest."""
    squares = np.einsum("nd,nd->n", vectors, vectors)
    return np.hstack([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]]).astype(np.float32)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: the shard's vectors, edges and the ids of each node, packed."""
    rows = rows.sort_values("node")
    vectors = np.array(rows["vector"].tolist(), np.float64)
    edges, start = build(_lifted(vectors))
    sizes = rows["members"].map(len).to_numpy(np.int64)
    ids = np.concatenate(rows["members"].to_numpy()).astype(np.int64)
    packed = [ids.tobytes(), sizes.tobytes(), vectors.tobytes(), edges.astype(np.int32).tobytes()]
    return pd.DataFrame([(rows["shard"].iloc[0], vectors.shape[1], start, *packed)], columns=["shard", "dims", "start", "ids", "sizes", "vectors", "edges"])


class Graph:
    """A shard as it was packed."""

    def __init__(self, dims: int, start: int, ids: bytes, sizes: bytes, vectors: bytes, edges: bytes):
        self.start = start
        self.vectors = np.frombuffer(vectors).reshape(-1, dims)
        self.edges = np.frombuffer(edges, np.int32).reshape(len(self.vectors), -1).astype(np.int64)
        self.members = np.split(np.frombuffer(ids, np.int64), np.cumsum(np.frombuffer(sizes, np.int64))[:-1])
        self.points = _lifted(self.vectors)
        self.squares = np.einsum("nd,nd->n", self.points, self.points)

    def search(self, query_ids: list[int], asked: np.ndarray, top: int) -> tuple[list, list, list]:
        """(query, id, score): the best ``top`` candidates of each query, own id left out."""
        flat = np.hstack([asked, np.zeros((len(asked), 1))]).astype(np.float32)
        beam, _ = beam_search(self.points, self.squares, self.edges, self.start, flat, min(SEARCH_BEAM, max(2, len(self.points))))
        out: tuple[list, list, list] = ([], [], [])
        for query_id, vector, held in zip(query_ids, asked, beam):
            found = held[held >= 0]
            scores = self.vectors[found] @ vector
            pairs: dict[int, float] = {}
            for s, k in zip(scores.tolist(), found):
                for m in self.members[k].tolist():
                    if m != query_id and (m not in pairs or s > pairs[m]):
                        pairs[m] = s
            best = sorted(pairs.items(), key=lambda p: (-p[1], p[0]))[:top]
            out[0].extend([query_id] * len(best))
            out[1].extend(m for m, _ in best)
            out[2].extend(s for _, s in best)
        return out


def _search_batches(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Rows come shard by shard, a graph and then its queries, which are searched in blocks."""
    graph: Graph | None = None
    ids: list[int] = []
    vectors: list[np.ndarray] = []

    def run() -> Iterator[pa.RecordBatch]:
        if ids:
            found = graph.search(ids, np.array(vectors, np.float64), top)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])
            ids.clear()
            vectors.clear()

    for batch in batches:
        for k, query_id in enumerate(batch["vec_id"].to_pylist()):
            if query_id is None:
                yield from run()
                graph = Graph(*(batch[c][k].as_py() for c in ("dims", "start", "ids", "sizes", "vectors", "edges")))
            else:
                ids.append(query_id)
                vectors.append(batch["vector"][k].values.to_numpy(zero_copy_only=False))
                if len(ids) >= BLOCK:
                    yield from run()
    yield from run()


def index(rows: DataFrame, top: int, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(shard, dims, start, ids, sizes, vectors, edges): a packed graph for each shard of all usable vectors."""
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    own = own.withColumn("hash", F.xxhash64("vector"))
    # Of equal vectors, the smallest ids: as many as a list can hold, and the query's own.
    place = F.row_number().over(Window.partitionBy("hash", "vector").orderBy("vec_id"))
    few = own.distinct().withColumn("place", place).where(F.col("place") <= top + 1)
    nodes = stored(few.groupBy("hash", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).withColumn("dims", F.size("vector")), "ann-nodes")
    shards = nodes.groupBy("dims").agg(F.ceil(F.count("*") / F.lit(shard)).alias("shards"))
    dealt = nodes.join(shards, "dims").withColumn("shard", F.pmod(F.xxhash64("hash", F.lit("shard")), "shards"))
    # Dimensions and shard in one key; a table has few dimensions.
    dealt = dealt.select(F.concat_ws("/", "dims", "shard").alias("shard"), F.element_at("members", 1).alias("node"), "vector", "members")
    return stored(dealt.groupBy("shard").applyInPandas(_build_shard, GRAPH), "ann-graph")


def search(rows: DataFrame, queries: DataFrame, top: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of all rows found for each row of ``queries``, which are rows too."""
    graph = index(rows, top, vec_id, vector, shard)
    asked = queries.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct()
    asked = stored(asked, "ann-queries")
    slices = max(1, -(-asked.count() // SLICE))
    graph = graph.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    none = [F.lit(None).cast(t).alias(c) for c, t in (c.split() for c in GRAPH.split(", ")) if c not in ("shard", "dims")]
    shards = graph.where("slice = 0").select("dims", "shard")
    # Each slice of the queries goes to each shard once: few keys, and no pairs of rows on either side.
    dealt = asked.withColumns({"slice": F.pmod(F.xxhash64("vec_id"), F.lit(slices)), "dims": F.size("vector")}).join(shards, "dims")
    dealt = dealt.select("shard", "slice", "vec_id", "vector", "dims", *none)
    graph = graph.select("shard", "slice", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("vector"), "dims", "start", "ids", "sizes", "vectors", "edges")
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = graph.unionByName(dealt).repartition(parallel, "shard", "slice").sortWithinPartitions("shard", "slice", F.col("vec_id").asc_nulls_first())
    found = met.mapInArrow(functools.partial(_search_batches, top=top), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

