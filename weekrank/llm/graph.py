"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Vectors are dealt into shards of a bounded size by a hash. In each shard every vector gets neighbours that a greedy
search through the graph so far proposes; relaxed distance pruning keeps diverse edges, and edges are returned. A beam
search asks every shard, and the nearest of all shards stay. Equal vectors are one node of one shard. For inner products every vector gets one more component
that makes all of them equally long, so that the largest inner product is the smallest distance.

Vectors that are null, zero, of another length than the first, or hold null or non-finite components take no part.
Repeated vectors are different candidates, found together; repeated ids count once per row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekrank.llm import common

SHARD, DEGREE, BUILD_BEAM, BEAM, RELAX, BATCH = 2500, 32, 48, 96, 1.2, 250
BLOCK = 2500  # queries that travel together
AT_ONCE = 500  # queries that step through a graph together
GROUPS = 8  # groups of shards that a block is taken through side by side
RUNS = 2


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(
        v.isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(v, lambda x: x != 0))


def beam_search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, beam: int, start: int):
    """Nodes and distances of each query's beam, nearest first; all queries step together."""
    n, q = len(points), len(queries)
    norms = (points ** 2).sum(axis=1)
    width = min(beam, n)
    nodes, far = np.full((q, width), -1), np.full((q, width), np.inf)
    nodes[:, 0], far[:, 0] = start, norms[start] - 2 * queries @ points[start]
    done, seen = np.zeros((q, width), bool), np.zeros((q, n), bool)
    seen[:, start] = True
    live = np.arange(q)
    while len(live):
        waiting = np.where(done[live] | (nodes[live] < 0), np.inf, far[live])
        pick = waiting.argmin(axis=1)
        some = np.isfinite(waiting[np.arange(len(live)), pick])
        live, pick = live[some], pick[some]
        if not len(live):
            break
        done[live, pick] = True
        near = edges[nodes[live, pick]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, start)] = True
        safe = np.maximum(near, 0)
        d = norms[safe] - 2 * np.einsum("qd,qkd->qk", queries[live], points[safe])
        d[~fresh] = np.inf
        all_far = np.concatenate([far[live], d], axis=1)
        by = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        far[live] = np.take_along_axis(all_far, by, 1)
        nodes[live] = np.where(np.isfinite(far[live]), np.take_along_axis(np.concatenate([nodes[live], near], axis=1), by, 1), -1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(fresh)], axis=1), by, 1)
    by = np.argsort(far, axis=1)
    return np.take_along_axis(nodes, by, 1), np.take_along_axis(far, by, 1)


def pruned(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each point the nearest candidate, again and again, without those that a kept one is `relax` times nearer to."""
    safe = np.maximum(candidates, 0)
    d = ((points[safe] - points[own][:, None]) ** 2).sum(axis=2)
    d[(candidates < 0) | (candidates == own[:, None])] = np.inf
    by = np.argsort(d, axis=1)
    safe, d = np.take_along_axis(safe, by, 1), np.take_along_axis(d, by, 1)
    repeat = np.zeros_like(d, bool)
    for k in range(1, d.shape[1]):
        repeat[:, k] = (safe[:, :k] == safe[:, k:k + 1]).any(axis=1)
    d[repeat] = np.inf
    out, rows = np.full((len(own), degree), -1), np.arange(len(own))
    left = d.copy()
    for k in range(degree):
        pick = left.argmin(axis=1)
        good = np.isfinite(left[rows, pick])
        if not good.any():
            break
        kept = safe[rows, pick]
        out[good, k] = kept[good]
        between = ((points[safe] - points[kept][:, None]) ** 2).sum(axis=2)
        left[good[:, None] & (relax * relax * between <= d)] = np.inf
        left[rows, pick] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 1) -> tuple[np.ndarray, int]:
    """Edges (n, 2 x degree; -1 where there are fewer) and the node that searches start from."""
    n, rng = len(points), np.random.default_rng(seed)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, 2 * degree), -1)
    if n > 1:
        some = min(degree // 2, n - 1)
        edges[:, :some] = (np.arange(n)[:, None] + rng.integers(1, n, (n, some))) % n
    for turn in range(RUNS):
        for own in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            found, _ = beam_search(points, edges, points[own], beam, start)
            new = pruned(points, own, np.concatenate([found, edges[own]], axis=1), degree, 1.0 if turn < RUNS - 1 else relax)
            edges[own] = -1
            edges[own, :degree] = new
            source, target = np.repeat(own, degree), new.ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            heads = np.flatnonzero(np.concatenate([[True], np.diff(target) != 0])) if len(target) else target
            full = []
            for node, more in zip(target[heads], np.split(source, heads[1:])):
                now = edges[node][edges[node] >= 0]
                more = more[~np.isin(more, now)]
                if len(now) + len(more) <= 2 * degree:
                    edges[node, len(now):len(now) + len(more)] = more
                    edges[node, :len(now)] = now
                else:
                    full.append((node, np.concatenate([now, more])))
            if full:
                wide = max(len(x) for _, x in full)
                nodes = np.array([node for node, _ in full])
                cut = pruned(points, nodes, np.array([np.pad(x, (0, wide - len(x)), constant_values=-1) for _, x in full]), degree, relax)
                edges[nodes] = -1
                edges[nodes, :degree] = cut
    return edges, start


class Heap:
    """The best k (id, score) of every query so far, flat and sorted by query, falling score and id."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k = q_ids, k
        self.owner, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, owner: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.q_ids[owner]
        owner, ids, scores = (np.concatenate([a, b[other]]) for a, b in ((self.owner, owner), (self.ids, ids), (self.scores, scores)))
        by = np.lexsort((ids, -scores, owner))
        owner = owner[by]
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
        place = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
        by = by[place < self.k]
        self.owner, self.ids, self.scores = owner[place < self.k], ids[by], scores[by]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[self.owner]), pa.array(self.ids), pa.array(self.scores)], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, *, shard: int = SHARD, beam: int = BEAM, block: int = BLOCK, groups: int = GROUPS) -> DataFrame:
    """query_id, rank, vec_id and score (inner product in doubles) of the k nearest that are found for each query.

    `vectors` and `queries` are as from `usable`. A query's own row is no candidate. Fewer than k candidates are all
    returned. Ties go to the smaller id. Equal vectors are one node; it stands for their k + 1 smallest ids, more of
    which no query can return. A task takes a block of queries through a group of shards one after the other and
    keeps their k best, so that it returns k rows a query whatever the number of shards.
    """
    head = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m"), F.max(F.size("v")).alias("d")).first()
    most, width = float(head["m"] or 0.0), int(head["d"] or 0)
    vectors, queries = vectors.filter(F.size("v") == width), queries.filter(F.size("v") == width)
    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = common.stored(vectors.select("vec_id", "v").withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"))
    shards = max(1, math.ceil(kept.df.count() / shard))
    blocks, groups = max(1, math.ceil(queries.count() / block)), min(groups, shards)

    def matrix(table: pa.Table, name: str):
        column = table.column(name).combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)

    def indexed(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        v, ids = matrix(table, "v") + 0.0, table.column("vec_id").to_numpy()
        _, first, node = np.unique(v.view([("", v.dtype)] * v.shape[1]).ravel(), return_index=True, return_inverse=True)
        points, ends = v[first], np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(first)))])
        edges, start = build(_long(points, most))
        return pa.table({"s": [int(table.column("s")[0].as_py())], "start": [start], "ids": [ids[np.argsort(node, kind="stable")].tobytes()],
                         "ends": [ends.astype(np.int64).tobytes()], "points": [points.tobytes()], "edges": [edges.astype(np.int32).tobytes()]})

    dealt = kept.df.withColumn("s", F.pmod(F.xxhash64("v", F.lit(3)), F.lit(shards)))
    index = common.stored(dealt.groupBy("s").applyInArrow(indexed, "s long, start long, ids binary, ends binary, points binary, edges binary"))
    kept.drop()

    def packed(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return pa.table({"b": [int(table.column("b")[0].as_py())], "ids": [table.column("vec_id").to_numpy().tobytes()], "points": [matrix(table, "v").tobytes()]})

    asked = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(blocks)).alias("b")).groupBy("b").applyInArrow(packed, "b long, ids binary, points binary")
    # Every block of the stated query set meets every shard: the queries come first, then the shards of the group.
    none, order = F.lit(None).cast("binary"), ["b", "g", "s"]
    numbers = [F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>") for n in (groups, blocks)]
    first = asked.select("b", F.explode(numbers[0]).alias("g"), F.lit(-1).cast("long").alias("s"), F.lit(0).cast("long").alias("start"), "ids", none.alias("ends"), "points", none.alias("edges"))
    then = index.df.select(F.explode(numbers[1]).alias("b"), (F.col("s") % groups).alias("g"), "s", "start", "ids", "ends", "points", "edges")
    meet = first.unionByName(then).repartitionByRange(blocks * groups, "b", "g").sortWithinPartitions(*order)

    def search(batches):
        now, heap, q = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                b, g, s, start = (batch.column(i)[row].as_py() for i in range(4))
                ids, ends, points, edges = (batch.column(i)[row].as_buffer() for i in range(4, 8))
                if (b, g) != now:
                    if heap is not None:
                        yield heap.rows()
                    now, heap = (b, g), None
                ids = np.frombuffer(ids, np.int64)
                if s < 0:
                    heap, q = Heap(ids, k), np.frombuffer(points).reshape(len(ids), -1)
                elif heap is not None:  # else the block has no queries
                    ends, points = np.frombuffer(ends, np.int64), np.frombuffer(points).reshape(-1, width)
                    edges, long = np.frombuffer(edges, np.int32).reshape(len(points), -1), _long(points, most)
                    for low in range(0, len(q), AT_ONCE):
                        some = q[low:low + AT_ONCE]
                        owner, node, score = _found(points, long, edges, ids[ends[:-1]], some, max(beam, 2 * k), k, start)
                        n = np.diff(ends)[node]
                        at = np.repeat(ends[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        heap.add(np.repeat(owner + low, n), ids[at], np.repeat(score, n))
        if heap is not None:
            yield heap.rows()

    found = meet.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _long(points: np.ndarray, most: float) -> np.ndarray:
    """With the component that makes all vectors equally long."""
    return np.concatenate([points, np.sqrt(np.maximum(most - (points ** 2).sum(axis=1), 0))[:, None]], axis=1).astype(np.float32)


def _found(points, long, edges, firsts, queries, beam: int, k: int, start: int):
    """Query, node and exact score of the best k + 1 nodes of each query's beam; ties to the node with the smaller id."""
    found, far = beam_search(long, edges, np.pad(queries, ((0, 0), (0, 1))).astype(np.float32), beam, start)
    node = np.maximum(found, 0)
    score = np.einsum("qd,qkd->qk", queries, points[node])
    score[(found < 0) | ~np.isfinite(far)] = -np.inf
    by = np.lexsort((firsts[node], -score), axis=1)[:, :k + 1]
    node, score = np.take_along_axis(node, by, 1), np.take_along_axis(score, by, 1)
    good = np.isfinite(score)
    return np.repeat(np.arange(len(queries)), good.sum(axis=1)), node[good], score[good]
