"""Approximate nearest neighbours by largest inner product, with a forest of random-projection trees.

Vectors are lifted onto a sphere (one more component, sqrt(M^2 - |x|^2)), where the
largest inner product is the smallest distance. Every tree splits at medians of random
projections, fitted on a bounded sample, down to leaves of about LEAF rows: the depth grows
with the table. Every row is routed to one leaf of each tree. A query walks all trees
through one priority queue, ordered by the squared distance to the cells behind the
hyperplanes it would have to cross, until it has popped as many leaves as the search
allows. The rows of those leaves are reranked exactly.

How many leaves is measured, not set: CALIBRATION queries are compared with all rows, and
the search allows the fewest leaves at which they find the wanted share of their true
neighbours. Clustered vectors need few leaves; isotropic ones, which have no near
neighbours in any useful sense, need a large part of the tree whatever the index.

Scale: the trees are a broadcast bounded by the sample. Leaves are grouped into blocks; a
block meets the queries that visit it in one task, and both sides are cut into chunks of
bounded size, so that copies of one vector, which share every leaf, spread over tasks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlint.llm.common import mix
from sparrowlint.runtime import Workspace, ship

SAMPLE_ROWS, SAMPLE_BYTES, TREES, LEAF, CALIBRATION = 65536, 64 << 20, 8, 64, 200
BLOCK_ROWS, BLOCK_QUERIES = 8192, 8192


class Forest:
    """Complete binary trees: hyperplanes and thresholds by node in level order."""

    def __init__(self, sample: np.ndarray, radius: float, trees: int, depth: int, seed: int):
        self.radius, self.depth = radius, max(0, min(depth, int(np.log2(max(1, len(sample)) / 4))))
        x, inner = self.lift(sample), (1 << self.depth) - 1
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, inner, x.shape[1])).astype(np.float32)
        self.planes /= np.maximum(np.linalg.norm(self.planes, axis=2, keepdims=True), 1e-12)
        self.cuts = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            rows = [np.arange(len(x))]
            for k in range(inner):
                own = rows[k]
                p = x[own] @ self.planes[t, k]
                self.cuts[t, k] = np.median(p) if len(own) else 0
                above = p > self.cuts[t, k]
                rows += [own[~above], own[above]]
                rows[k] = own[:0]

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.radius**2 - np.einsum("ij,ij->i", x, x, dtype=np.float64)))
        return np.hstack([x, rest[:, None]]).astype(np.float32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        x = self.lift(x)
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.planes[t][node]) > self.cuts[t][node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def margins(self, q: np.ndarray) -> np.ndarray:
        return self.planes @ np.append(q * (self.radius / np.linalg.norm(q)), 0).astype(np.float32) - self.cuts

    def visits(self, q: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The first ``most`` leaves of one query, (tree, leaf), best first through the shared queue."""
        inner = (1 << self.depth) - 1
        margin = self.margins(q).tolist()
        heap, out = [(0.0, t, 0) for t in range(len(self.planes))], []
        while heap and len(out) < most:
            far, t, node = heapq.heappop(heap)
            own = margin[t]
            while node < inner:
                m = own[node]
                right = m > 0
                heapq.heappush(heap, (far + m * m, t, 2 * node + (1 if right else 2)))
                node = 2 * node + (2 if right else 1)
            out.append((t, node - inner))
        return out

    def places(self, q: np.ndarray) -> np.ndarray:
        """The place of every leaf of every tree in a query's order of visits."""
        margin = self.margins(q).astype(np.float64)
        far = np.zeros((len(margin), 1))
        for d in range(self.depth):
            m = margin[:, (1 << d) - 1 : (2 << d) - 1]
            far = np.stack([far + np.where(m > 0, m * m, 0), far + np.where(m > 0, 0, m * m)], axis=2).reshape(len(margin), -1)
        out = np.empty(far.size, np.int64)
        out[np.argsort(far, axis=None, kind="stable")] = np.arange(far.size)
        return out.reshape(far.shape)


def _matrix(col, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, str]:
    """``(id, v)`` without what takes no part, one row per id, the dimension, and the type of the components (float stays float)."""
    kind = vectors.schema[vec_col].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~bad & F.exists("v", lambda x: x != 0))
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dims[0].d if dims else 0
    return v.where(F.size("v") == dim).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v")), dim, kind


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The rows of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        low = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= low)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def neighbours(base: DataFrame, q: np.ndarray, qids: np.ndarray, dim: int, k: int) -> dict[int, np.ndarray]:
    """The vectors of the k true neighbours of a few queries, by comparison with all rows: each task keeps its best k."""
    shared = base.sparkSession.sparkContext.broadcast((q, qids))

    def scan(it):
        q, qids = shared.value
        ids, xs, scores = np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros((len(q), 0))
        for b in it:
            x = _matrix(b.column("v"), dim)
            ids, xs = np.concatenate([ids, b.column("id").to_numpy()]), np.vstack([xs, x])
            scores = np.hstack([scores, q @ x.T])
            scores[qids[:, None] == ids[None, :]] = -np.inf
            keep = np.unique(np.concatenate([best(ids, s, k) for s in scores]))
            ids, xs, scores = ids[keep], xs[keep], scores[:, keep]
        for i, s in enumerate(scores):
            own = best(ids, s, k)
            own = own[np.isfinite(s[own])]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(ids[own]), pa.array(s[own]), pa.array(list(xs[own]), pa.list_(pa.float64()))], ["q", "id", "score", "v"])

    near = base.mapInArrow(scan, "q long, id long, score double, v array<double>")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    rows = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "v").collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r.q, []).append(r.v)
    return {i: np.array(v) for i, v in found.items()}


def enough_leaves(forest: Forest, q: np.ndarray, true: dict[int, np.ndarray], recall: float) -> int:
    """The fewest leaves with which the queries find the wanted share of their true neighbours."""
    seen = [forest.places(q[i])[np.arange(len(forest.planes))[None, :], forest.leaves(v)].min(axis=1) for i, v in true.items()]
    seen = np.sort(np.concatenate(seen)) if seen else np.zeros(1, np.int64)
    return int(seen[min(len(seen) - 1, int(np.ceil(recall * len(seen))))]) + 1


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, trees: int = TREES, recall: float = 0.95, leaf: int = LEAF, seed: int = 11) -> DataFrame:
    """The k nearest found of each query: query_id, rank from 1, the id column, score, visited.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but
    those with the query's id. score is the inner product of the original vectors in
    double precision; ties go to the smaller id. visited is the share of the forest's
    leaves that each query searched. Rows with a null id, a null, empty or zero vector, null
    or non-finite components, or a length other than the commonest take no part. A repeated
    id counts once. With fewer candidates than k all those found are returned; an empty
    table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    ws = Workspace(spark, "ann")
    base, dim, kind = usable(vectors, id_col, vec_col)
    base = ws.table(base, "vectors")
    out = f"query_id long, rank int, {id_col} long, score double, visited double"
    stats = base.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("sq")).first()
    queries = base.where(F.col("id") % every == 0)
    asking = queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).toArrow() if stats.n else None
    if not stats.n or not asking.num_rows:
        return spark.createDataFrame([], out)
    bound = max(LEAF, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    sample = base.orderBy(F.xxhash64("id"), "id").limit(bound).select("v").toArrow().column("v").combine_chunks()
    forest = Forest(_matrix(sample, dim), float(np.sqrt(stats.sq)), trees, int(np.ceil(np.log2(max(1, stats.n / leaf)))), seed)
    model = spark.sparkContext.broadcast(forest)
    few, few_ids = _matrix(asking.column("v").combine_chunks(), dim), asking.column("id").to_numpy()
    most = enough_leaves(forest, few, neighbours(base, few, few_ids, dim, k), recall)
    visited = min(1.0, most / (trees << forest.depth))
    shift = max(0, min(forest.depth, int(np.log2(BLOCK_ROWS / max(1, stats.n / (1 << forest.depth))))))

    def route(it):
        for b in it:
            x = _matrix(b.column("v"), dim)
            if len(x):
                leaf = model.value.leaves(x)
                idx = pa.array(np.repeat(np.arange(len(x)), trees))
                yield pa.RecordBatch.from_arrays([b.column("id").take(idx), pa.array(np.tile(np.arange(trees), len(x))), pa.array(leaf.ravel()), b.column("v").take(idx)], ["id", "tree", "leaf", "v"])

    routed = base.mapInArrow(route, f"id long, tree long, leaf long, v array<{kind}>")
    # One row per leaf: trees times 2**depth, which the sample bounds.
    blocks = np.zeros((trees, 1 << (forest.depth - shift)), np.int64)
    for r in routed.groupBy("tree", F.shiftright("leaf", shift).alias("block")).count().collect():
        blocks[r.tree, r.block] = r["count"]
    parts = np.maximum(1, -(-blocks // BLOCK_ROWS))

    def ask(it):
        for b in it:
            x = _matrix(b.column("v"), dim)
            rows, keys, lists = [], [], []
            for i in range(len(x)):
                mine: dict[tuple[int, int], list[int]] = {}
                for t, f in model.value.visits(x[i], most):
                    mine.setdefault((t, f >> shift), []).append(f)
                rows += [i] * len(mine)
                keys += mine
                lists += mine.values()
            if rows:
                key = np.array(keys)
                idx = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), b.column("id").take(idx), pa.array(lists, pa.list_(pa.int64())), b.column("v").take(idx)], ["tree", "block", "query_id", "leaves", "qv"])

    asked = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(ask, f"tree long, block long, query_id long, leaves array<long>, qv array<{kind}>")
    asked = ws.table(asked, "asked")
    chunks = np.ones_like(parts)
    for r in asked.groupBy("tree", "block").count().collect():
        chunks[r.tree, r.block] = max(1, -(-r["count"] // BLOCK_QUERIES))
    shared = spark.sparkContext.broadcast((parts, chunks))

    def deal(rows: pa.RecordBatch, own: np.ndarray, other: np.ndarray, ids: str, mine: str, theirs: str):
        """Each row in its own slice of its block, once for each slice of the other side."""
        t, g = rows.column("tree").to_numpy(), rows.column("block").to_numpy()
        slot = (mix(rows.column(ids).to_numpy().astype(np.uint64)) % own[t, g].astype(np.uint64)).astype(np.int64)
        times = other[t, g]
        idx = np.repeat(np.arange(len(t)), times)
        each = np.arange(len(idx)) - np.repeat(np.cumsum(times) - times, times)
        out = rows.take(pa.array(idx))
        return out.append_column(mine, pa.array(slot[idx])).append_column(theirs, pa.array(each))

    def place(it):
        part, chunk = shared.value
        for b in it:
            b = b.append_column("block", pa.array(b.column("leaf").to_numpy() >> shift))
            yield deal(b, part, chunk, "id", "part", "chunk").select(["tree", "block", "part", "chunk", "leaf", "id", "v"])

    def pose(it):
        part, chunk = shared.value
        for b in it:
            yield deal(b, chunk, part, "query_id", "chunk", "part").select(["tree", "block", "part", "chunk", "query_id", "leaves", "qv"])

    def rank(points: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if points.num_rows and asked.num_rows:
            points = points.sort_by("leaf")
            x, q = _matrix(points.column("v").combine_chunks(), dim), _matrix(asked.column("qv").combine_chunks(), dim)
            ids, qids, leaf = points.column("id").to_numpy(), asked.column("query_id").to_numpy(), points.column("leaf").to_numpy()
            lists = asked.column("leaves").combine_chunks()
            names, begin = np.unique(leaf, return_index=True)
            begin = np.append(begin, len(leaf))
            flat = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
            known = names[at] == flat
            seen = np.zeros((len(q), len(names)), bool)
            seen[np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))[known], at[known]] = True
            for a in range(0, len(q), 512):
                s = np.full((min(512, len(q) - a), len(x)), -np.inf)
                # Only the leaves that a query visits are compared with it.
                for j in range(len(names)):
                    rows = np.flatnonzero(seen[a : a + 512, j])
                    if len(rows):
                        s[rows, begin[j] : begin[j + 1]] = q[a + rows] @ x[begin[j] : begin[j + 1]].T
                s[qids[a : a + 512, None] == ids[None, :]] = -np.inf
                for i, row in enumerate(s, a):
                    low = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                    pick = np.flatnonzero((row >= low - 1e-9 * (1 + abs(low)) if np.isfinite(low) else row > -np.inf) & (row > -np.inf))
                    if len(pick):
                        exact = (x[pick] * q[i]).sum(axis=1)
                        top = np.lexsort((ids[pick], -exact))[:k]
                        found.append((np.full(len(top), qids[i]), ids[pick][top], exact[top]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, cols))))

    key = ["tree", "block", "part", "chunk"]
    placed = routed.mapInArrow(place, f"tree long, block long, part long, chunk long, leaf long, id long, v array<{kind}>")
    posed = asked.mapInArrow(pose, f"tree long, block long, part long, chunk long, query_id long, leaves array<long>, qv array<{kind}>")
    near = placed.groupBy(*key).cogroup(posed.groupBy(*key)).applyInArrow(rank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    top = once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", F.col("vec_id").alias(id_col), "score", F.lit(visited).alias("visited"))
