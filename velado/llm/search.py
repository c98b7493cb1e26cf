"""Operator 3, exact top-k search by inner product with a KD-tree for each shard.

Vectors are spread over shards by hash; a shard's tree has median splits and tight bounding boxes. A query walks a
tree best-first by the highest inner product that a box allows, and stops below its k-th best score so far. That
score is propagated: every query first searches one shard, then takes its k-th score along to all others. Queries go
in groups, so a task holds one shard and one group of queries, whatever the number of rows.
"""

from __future__ import annotations

import heapq
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velado.llm.util import stored

K, SHARD_ROWS, GROUP_ROWS, LEAF = 5, 8192, 4096, 128
LOWEST = -(1 << 62)


class KdTree:
    """Nodes as arrays; node i has the points ``order[begin[i]:end[i]]`` and children ``left[i]``, ``right[i]``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.begin, self.end, self.left, self.right, low, high = [], [], [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.begin)
            own = points[self.order[a:b]]
            low.append(own.min(0))
            high.append(own.max(0))
            for x, v in ((self.begin, a), (self.end, b), (self.left, -1), (self.right, -1)):
                x.append(v)
            if parent >= 0:
                side = self.left if self.left[parent] < 0 else self.right
                side[parent] = node
            if b - a > leaf and (high[-1] > low[-1]).any():
                mid = (b - a) // 2
                axis = int((high[-1] - low[-1]).argmax())
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                todo += [(a + mid, b, node), (a, a + mid, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, ids: np.ndarray, own: int, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, id) not below ``floor``, best first, ties to the smaller id; row ``own`` is left out.
        ``ids`` are in the order of ``points``."""
        best: list[tuple[float, int]] = []  # a heap: the worst of the best first
        heap = [(-bound[0], 0)]
        while heap:
            limit, node = heapq.heappop(heap)
            if -limit < floor:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.begin[node], self.end[node]
            scores = self.points[a:b] @ query
            for i in np.flatnonzero(scores >= floor):
                if a + i == own:
                    continue
                item = (scores[i], -int(ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, uid, dim, v`` of the rows that take part: v = floor(scale * component), uid a number of the row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column("v")
            off = col.offsets.to_numpy()
            flat = np.floor(col.values.to_numpy()[off[0] : off[-1]] * scale).astype(np.int64)
            v = pa.ListArray.from_arrays(pa.array(off - off[0]), pa.array(flat))
            ids = pa.array(np.arange(uid, uid + batch.num_rows))
            uid += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), ids, batch.column("dim"), v], ["vec_id", "uid", "dim", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = rows.where(fine).select("vec_id", F.size("v").alias("dim"), "v")
    return rows.mapInArrow(work, "vec_id long, uid long, dim int, v array<long>")


def _matrix(table: pa.Table) -> np.ndarray:
    col = table.column("v").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy()[off[0] : off[-1]].reshape(table.num_rows, -1)
    # Doubles add such products exactly below 2^53; larger components stay integers.
    return flat.astype(float) if float(np.abs(flat).max(initial=0)) ** 2 * max(flat.shape[1], 1) < 2**52 else flat


def _search(k: int):
    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if shard.num_rows and queries.num_rows:
            tree = KdTree(_matrix(shard))
            ids, uids = (shard.column(c).to_numpy()[tree.order] for c in ("vec_id", "uid"))
            place = {int(u): i for i, u in enumerate(uids)}
            q = _matrix(queries)
            if q.dtype != tree.points.dtype:
                q, tree.points, tree.low, tree.high = (x.astype(np.int64) for x in (q, tree.points, tree.low, tree.high))
            bounds = tree.bounds(q)
            names = ("vec_id", "uid", "floor")
            for i, (qid, uid, floor) in enumerate(zip(*(queries.column(c).to_pylist() for c in names))):
                found = tree.search(q[i], bounds[i], ids, place.get(uid, -1), k, floor)
                out += [(uid, qid, v, int(s)) for s, v in found]
        return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("uid", "query_id", "vec_id", "score"))})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 50, k: int = K, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows for every row whose vec_id is divisible by ``every``.

    Vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null vec_id.
    A repeated row is another row: it finds its copy, never itself. Vectors meet only those of their own length.
    Ties go to the smaller vec_id; with fewer than k other rows all of them return. An empty table gives no rows.
    Scores must fit 64 bits. Other columns are ignored.
    """
    rows = stored(quantized(vectors))
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    groups = max(1, -(-rows.where(F.col("vec_id") % every == 0).count() // group_rows))
    home = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    spread = rows.withColumn("shard", home)
    queries = stored(spread.where(F.col("vec_id") % every == 0))
    schema = "uid long, query_id long, vec_id long, score long"

    first = spread.groupBy("dim", "shard").cogroup(queries.withColumn("floor", F.lit(LOWEST)).groupBy("dim", "shard"))
    near = stored(_best(first.applyInArrow(_search(k), schema), k))
    floors = near.where(F.col("rank") == k).select("uid", F.col("score").alias("floor"))
    asked = queries.join(floors, "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "uid"), F.lit(groups)).cast("int")).withColumnRenamed("shard", "home")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").drop("home")
    copies = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    rest = copies.groupBy("dim", "shard", "part").cogroup(asked.groupBy("dim", "shard", "part")).applyInArrow(_search(k), schema)
    return _best(near.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
