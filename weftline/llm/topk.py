"""Exact top-k by inner product with a KD-tree per shard."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Vectors of a shard, at most about, and at least while there are fewer shards than cores; queries of a block. They bound what one task holds.
SHARD, LEAST, QUERIES, LEAF = 32768, 2048, 512, 256
#: Vectors that queries meet first, to know a score that others reach; any would do, as results are exact whatever they are.
SAMPLE = 1024
_LONG = 2**63


class Tree:
    """Median splits along the widest side of each node's tight box, down to leaves of LEAF vectors."""

    def __init__(self, points: np.ndarray):
        self.order, self.low, self.high, self.kids, self.span = np.arange(len(points)), [], [], [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            at, to, parent, side = stack.pop()
            part = points[self.order[at:to]]
            low, high = part.min(axis=0), part.max(axis=0)
            me = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.kids.append([-1, -1])
            self.span.append((at, to))
            if parent >= 0:
                self.kids[parent][side] = me
            wide = int(np.argmax(high - low))
            if to - at > LEAF and high[wide] > low[wide]:
                mid = (to - at) // 2
                self.order[at:to] = self.order[at:to][np.argpartition(part[:, wide], mid, kind="introselect")]
                stack += [(at, at + mid, me, 0), (at + mid, to, me, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the largest inner product that a point in the node's box can have."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, floors: list, k: int) -> list:
    """(query's row, id, score) of each query's k best, the query's own row left out. floors: a score that k others are known to
    reach; boxes below it are passed over, as are those below the kth best so far."""
    bounds, out = tree.bounds(queries), []
    for q in range(len(queries)):
        best: list[tuple] = []  # a heap of (score, -id, place), the worst first
        heap = [(-bounds[q, 0], 0)]

        def limit():
            return max(floors[q], best[0][0]) if len(best) == k else floors[q]

        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < limit():
                break
            left, right = tree.kids[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[q, left], left))
                heapq.heappush(heap, (-bounds[q, right], right))
                continue
            at, to = tree.span[node]
            of = tree.order[at:to]
            scores = points[of] @ queries[q]
            hit = [j for j in np.flatnonzero(scores >= limit()) if rows[of[j]] != own[q]]
            if len(hit) > k:  # of many equals only the smallest ids can stay
                hit = sorted(hit, key=lambda j: (-scores[j], ids[of[j]]))[:k]
            for j in hit:
                new = (scores[j], -int(ids[of[j]]), int(of[j]))
                heapq.heappush(best, new) if len(best) < k else heapq.heappushpop(best, new)
        out += [(int(own[q]), -i, max(-_LONG, min(_LONG - 1, int(s)))) for s, i, _ in best]
    return out


def _exact(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are if floats hold all their products exactly, else as whole numbers of any size."""
    if float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, points.shape[1]) < 2.0**52:
        return points, queries
    return tuple(np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (points, queries))


def _searcher(k: int):
    def run(batches):
        """Of each shard its vectors come first, then its queries, which pass by in blocks: a task holds one shard and one block."""
        key, held, tree = None, [], None
        for batch in batches:
            dim, shard, asks, row, vec, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3, 4, 6))
            values, ends = batch.column(5).flatten().to_numpy(zero_copy_only=False), np.cumsum(dim)
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(asks) != 0)) + 1
            for at, to in zip([0, *cuts], [*cuts, len(dim)]):
                if to <= at:
                    continue
                if (dim[at], shard[at]) != key:
                    key, held, tree = (dim[at], shard[at]), [], None
                q = values[ends[at] - dim[at] : ends[to - 1]].reshape(to - at, dim[at])
                if not asks[at]:
                    held.append((q.copy(), vec[at:to].copy(), row[at:to].copy()))
                    continue
                if not held:
                    continue
                if tree is None:
                    points, ids, rows = (np.concatenate(x) for x in zip(*held))
                    held, tree = [(points, ids, rows)], Tree(points)
                for b in range(at, to, QUERIES):
                    part = slice(b - at, min(b + QUERIES, to) - at)
                    p, x = _exact(points, q[part])
                    known = [int(f) if f == f and f is not None else -np.inf for f in floor[at:to][part]]
                    found = search(tree if p is points else Tree(p), p, ids, rows, x, row[at:to][part], known, k)
                    cols = list(zip(*found)) if found else [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["of", "vec_id", "score"])

    return run


def _floors(sample: list, k: int):
    """For each query the kth best score among the sampled vectors of its length, the query's own row left out: others reach it. Null where they are too few."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r["q"]) for r in sample}:
        some = [r for r in sample if len(r["q"]) == dim]
        by_dim[dim] = np.array([r["q"] for r in some], float), np.array([r["row"] for r in some])

    def run(batches):
        for batch in batches:
            out = []
            for row, q in zip(batch.column("row").to_pylist(), batch.column("q")):
                own = np.array(q.values.to_numpy(zero_copy_only=False), float)
                points, rows = by_dim.get(len(own), (np.empty((0, len(own))), np.empty(0, int)))
                p, x = _exact(points[rows != row], own[None])
                best = sorted((p @ x[0]).tolist(), reverse=True)[:k]
                out.append(min(int(best[-1]), _LONG - 1) if len(best) == k and best[-1] >= -_LONG else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.int64())], ["row", "floor"])

    return run


def quantized(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, q: floor(256 x) of each component, as a double, which holds it exactly. Null ids and vectors null, empty or with null or
    non-finite components take no part."""
    ok = F.col("vec_id").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    most = F.lit(1.7e308)
    scaled = F.transform("embedding", lambda x: F.greatest(F.least(F.lit(256.0) * x.cast("double"), most), -most))
    q = F.transform(scaled, lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0))  # floor() would give a long
    return embeddings.select("vec_id", "embedding").filter(ok).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k rows (not itself) with the largest
    inner product of quantized vectors, ties to the smaller vec_id.

    Vectors are dealt by a hash of the row to shards of about SHARD, each of which gets a KD-tree in one task; the queries come to the
    shard and stream by in blocks, so vectors move once and a task's memory doesn't grow. Where the queries lie, SAMPLE vectors give each
    a kth score, which every shard starts from; the shards' best meet in a last top-k by query.

    Vectors of other lengths never meet. Ids divisible by `every` include 0 and negative ones. Repeated rows: each is a candidate, and a
    query of its own if its id is divisible; only the query's own row is left out. Scores are exact; those beyond a long
    are told as the largest or smallest long. Fewer than k others: all. Null ids, vectors null or empty or with components null or
    non-finite: no part. Empty table: no rows. Other columns don't matter.
    """
    vectors = saved(quantized(embeddings), "vectors")
    count = vectors.count()
    shards = max(1, -(-count // SHARD), min(embeddings.sparkSession.sparkContext.defaultParallelism, count // LEAST))
    dealt = vectors.select(F.size("q").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "row", "vec_id", "q", F.lit(None).cast("long").alias("floor"))
    asked = vectors.filter(F.col("vec_id") % every == 0)

    def meet(points, queries, first, to):
        over = F.explode(F.sequence(F.lit(first), F.lit(to)))
        both = points.union(queries.select(F.size("q").alias("dim"), over.alias("shard"), F.lit(True).alias("asks"), "row", "vec_id", "q", "floor"))
        both = both.repartition(max(1, to - first + 1), "dim", "shard").sortWithinPartitions("dim", "shard", "asks")
        return both.mapInArrow(_searcher(k), "of long, vec_id long, score long")

    sample = vectors.select("row", "q").limit(SAMPLE).collect()
    floors = asked.select("row", "q").mapInArrow(_floors(sample, k), "row long, floor long").withColumnRenamed("row", "its")
    found = meet(dealt, asked.join(floors, F.col("row") == F.col("its"), "left"), 0, shards - 1)
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
    return best.join(asked.select(F.col("row").alias("its"), F.col("vec_id").alias("query_id")), F.col("of") == F.col("its")).select("query_id", "rank", "vec_id", "score")
