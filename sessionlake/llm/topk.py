"""Exact top-k inner products by ball trees, one per shard.

Vectors go to the nearest of a bounded number of pivots; those of one pivot
make a ball, cut into shards of bounded size, and every shard gets one ball
tree, built once. Queries form blocks of bounded size with those of the same
ball. A node's scores are at most ``q.centre + |q| * radius``. Each block
first searches one shard of the ball with the highest bound. The kth scores
found there are shared: only the balls whose bound reaches them are searched
next, and only to these do trees and queries move. Inside a shard the bound
prunes level by level, and leaves are visited best bound first.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 1024, 128
#: Pivots at most; their vectors and radii are broadcast.
PIVOTS = 1024
#: Scores up to this are exact in float64; above it, leaves are scored in Python integers.
_EXACT = 2**53


def quantize(embedding: Column) -> Column:
    """floor(256 * x) of each component as integers; null if the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * 256)))


def _tree(points: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Order of the points by leaf, and for each level the (start, end) of its balls; the last level has the leaves."""
    order = np.arange(len(points))
    levels = [[(0, len(points))]]
    while any(e - s > LEAF_ROWS for s, e in levels[-1]):
        below = []
        for s, e in levels[-1]:
            if e - s <= LEAF_ROWS:
                below.append((s, e))
                continue
            part = points[order[s:e]]
            far = part[np.argmax(((part - part.mean(axis=0)) ** 2).sum(axis=1))]
            other = part[np.argmax(((part - far) ** 2).sum(axis=1))]
            along = part @ (other - far)
            order[s:e] = order[s:e][np.argsort(along, kind="stable")]
            m = (s + e) // 2
            below += [(s, m), (m, e)]
        levels.append(below)
    return order, levels


def _bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bound of every query's scores in every ball, with room for rounding."""
    norms = np.sqrt((queries**2).sum(axis=1))[:, None]
    sizes = np.sqrt((centres**2).sum(axis=1)) + radii
    return queries @ centres.T + norms * radii + 1e-9 * norms * sizes + 1e-6


def _plant(points: np.ndarray, ids: np.ndarray) -> dict:
    """A shard's tree: its points and ids by leaf, and of each level the balls, their children in the next, centres and radii."""
    as_float = points.astype(np.float64)
    order, levels = _tree(as_float)
    points, as_float, ids = points[order], as_float[order], ids[order]
    nodes = []
    for depth, balls in enumerate(levels):
        centres = np.array([as_float[s:e].mean(axis=0) for s, e in balls])
        radii = np.array([np.sqrt(((as_float[s:e] - c) ** 2).sum(axis=1).max()) for (s, e), c in zip(balls, centres)])
        starts = np.array([s for s, _ in levels[depth + 1]]) if depth + 1 < len(levels) else None
        children = None if starts is None else [np.flatnonzero((starts >= s) & (starts < e)) for s, e in balls]
        nodes.append((balls, children, centres, radii))
    return {"points": points, "ids": ids, "nodes": nodes}


def _search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, tree: dict, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Top k (rows of queries, ids, scores) of one shard for each query, no score below ``floor``."""
    points, ids, nodes = tree["points"], tree["ids"], tree["nodes"]
    as_float = queries.astype(np.float64)
    large = points.shape[1] and float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * points.shape[1] >= _EXACT
    scored, by = (points.astype(object), queries.astype(object)) if large else (points.astype(np.float64), as_float)
    kth = floor.copy()
    alive_q, alive_n = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
    bound = np.full(len(queries), np.inf)
    for _, children, centres, radii in nodes:  # branch: balls that may still hold a result, then their children
        bound = _bounds(as_float, centres, radii)[alive_q, alive_n]
        keep = bound >= kth[alive_q]
        alive_q, alive_n, bound = alive_q[keep], alive_n[keep], bound[keep]
        if children is not None:
            counts = np.array([len(children[n]) for n in alive_n], dtype=np.int64)
            alive_q, alive_n = np.repeat(alive_q, counts), np.concatenate([children[n] for n in alive_n] or [alive_n])
    # bound: each query takes its leaves from the best bound down
    best = np.lexsort((-bound, alive_q))
    alive_q, alive_n, bound = alive_q[best], alive_n[best], bound[best]
    turn = np.arange(len(alive_q)) - np.searchsorted(alive_q, alive_q)
    top: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id), best first
    for t in range(int(turn.max()) + 1 if len(turn) else 0):
        now = np.flatnonzero((turn == t) & (bound >= kth[alive_q]))
        if not len(now):
            break  # bounds only fall and kth scores only rise from here
        for leaf in np.unique(alive_n[now]):
            q = alive_q[now[alive_n[now] == leaf]]
            s, e = nodes[-1][0][leaf]
            scores = by[q] @ scored[s:e].T
            for n, row in zip(q.tolist(), scores):
                if not large and len(row) > 4 * k:  # those that tie with the kth of the leaf stay
                    near = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1])
                else:
                    near = range(len(row))
                found = top[n] + [(-int(row[i]), int(ids[s + i])) for i in near if ids[s + i] != query_ids[n]]
                found.sort()
                top[n] = found[:k]
                if len(top[n]) == k:
                    kth[n] = max(kth[n], float(-top[n][-1][0]))
    out = [(n, i, -s) for n, found in enumerate(top) for s, i in found if -s >= floor[n]]
    return np.array([x[0] for x in out], dtype=np.int64), np.array([x[1] for x in out], dtype=np.int64), [max(-(2**63), min(2**63 - 1, x[2])) for x in out]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.int64).reshape(len(vectors), -1)


def _grow(rows: pd.DataFrame) -> pd.DataFrame:
    """The tree of one shard."""
    one = rows[["dim", "ball", "part"]].iloc[:1].reset_index(drop=True)
    return one.assign(tree=[pickle.dumps(_plant(_matrix(rows["vector"]), rows["vec_id"].to_numpy(dtype=np.int64)))])


def _cell(shard: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """One block of queries at one shard."""
    if not len(shard) or not len(block):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    own = block["query_id"].to_numpy(dtype=np.int64)
    row, i, s = _search(_matrix(block["vector"]), own, block["floor"].to_numpy(dtype=np.float64), pickle.loads(shard["tree"].iloc[0]), k)
    return pd.DataFrame({"query_id": own[row], "vec_id": i, "score": np.array(s, dtype=np.int64)})


class _Balls:
    """The balls of each vector length: numbers, pivots and, once known, radii. Lengths without a pivot have one ball, -1."""

    def __init__(self, pivots: list[list[int]]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(p) for p in pivots}:
            numbers = np.array([n for n, p in enumerate(pivots) if len(p) == dim])
            self.of[dim] = numbers, np.array([pivots[n] for n in numbers], dtype=np.float64).reshape(len(numbers), dim)
        self.radii: dict[int, float] = {}

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ball of each point and the distance to its pivot."""
        if points.shape[1] not in self.of:
            return np.full(len(points), -1), np.zeros(len(points))
        numbers, centres = self.of[points.shape[1]]
        near = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
        return numbers[near], np.sqrt(((points - centres[near]) ** 2).sum(axis=1))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the balls that hold vectors of the queries' length, and each query's bound in each."""
        if queries.shape[1] not in self.of:
            return np.array([-1]), np.full((len(queries), 1), np.inf)
        numbers, centres = self.of[queries.shape[1]]
        held = np.array([n in self.radii for n in numbers.tolist()])
        return numbers[held], _bounds(queries, centres[held], np.array([self.radii[n] for n in numbers[held].tolist()]))


def _by_length(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for _, rows in batch.groupby("dim"):
            yield rows.reset_index(drop=True), _matrix(rows["vector"]).astype(np.float64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` highest inner products.

    ``vectors``: ``vec_id`` and ``vector`` (integers; rows where it or the id
    is null take no part; extra columns are ignored). Candidates are all rows
    of the query's length but those with its own vec_id; ties go to the
    smaller vec_id. A repeated query id is asked once, with its shortest and
    then smallest vector; repeated candidates count each, and equal vectors
    are dealt to several shards. Scores are exact integers, held at the ends of
    the 64-bit range. An empty table, or one without queries, gives no rows.
    """
    rows = materialize(vectors.filter("vector is not null and vec_id is not null").select("vec_id", "vector", F.size("vector").alias("dim"), is_query.alias("asks")), "topk-vectors")
    spark, n_rows = rows.sparkSession, rows.count()
    # a bounded sample of rows to start balls from; every row goes into one
    sample = rows.select("vector").orderBy(F.xxhash64("vec_id", "vector")).limit(min(pivots, -(-n_rows // shard_rows))).collect()
    balls = _Balls([list(v) for v in dict.fromkeys(tuple(r["vector"]) for r in sample)])

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, points in _by_length(batches):
            part["ball"], part["away"] = balls.nearest(points)
            yield part

    homed = rows.mapInPandas(home, "vec_id long, vector array<long>, dim int, asks boolean, ball int, away double").withColumn("row", F.monotonically_increasing_id())
    homed = materialize(homed, "topk-homed")
    sizes = homed.groupBy("dim", "ball").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"), F.greatest(F.lit(1), F.ceil(F.count_if("asks") / block_rows)).cast("int").alias("subs"))
    sizes = materialize(sizes, "topk-balls")
    balls.radii = {r["ball"]: r["radius"] for r in sizes.filter("ball >= 0").select("ball", "radius").collect()}  # at most ``pivots`` rows
    parts = sizes.select("dim", "ball", "parts")
    shards = homed.join(parts, ["dim", "ball"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    trees = materialize(shards.select("dim", "ball", "part", "vec_id", "vector").groupBy("dim", "ball", "part").applyInPandas(_grow, "dim int, ball int, part int, tree binary"), "topk-trees")

    asked = homed.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("dim", "vector", "ball")).alias("q")).select("query_id", "q.dim", "q.vector", "q.ball")
    blocks = asked.join(sizes.select("dim", "ball", "subs"), ["dim", "ball"]).withColumn("sub", F.pmod(F.xxhash64("query_id"), F.col("subs")).cast("int"))
    queries = materialize(blocks.select("query_id", "dim", "vector", F.col("ball").alias("home"), "sub"), "topk-queries")

    def reach(batches: Iterator[pd.DataFrame], all_but_first: bool) -> Iterator[pd.DataFrame]:
        """Each query at the ball of its highest bound, or at every ball whose bound reaches its kth score."""
        for part, points in _by_length(batches):
            numbers, bounds = balls.bounds(points)
            best = np.argmax(bounds, axis=1)
            q, b = np.nonzero(bounds >= part["floor"].to_numpy(dtype=np.float64)[:, None]) if all_but_first else (np.arange(len(part)), best)
            yield part.iloc[q].assign(ball=numbers[b], first=best[q] == b)

    def search(of: DataFrame, all_but_first: bool) -> DataFrame:
        met = of.mapInPandas(lambda batches: reach(batches, all_but_first), "query_id long, dim int, vector array<long>, home int, sub int, floor double, ball int, first boolean")
        first_part = F.pmod(F.xxhash64("home", "sub"), F.col("parts")).cast("int")
        each = F.when(F.col("first"), F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), first_part)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        cells = met.join(parts, ["dim", "ball"]).withColumn("part", F.explode(each if all_but_first else F.array(first_part)))
        cells = materialize(cells.select("dim", "ball", "part", "home", "sub", "query_id", "vector", "floor"), "topk-cells")
        moved = trees.join(cells.select("dim", "ball", "part", "home", "sub").distinct(), ["dim", "ball", "part"])
        keys = ["dim", "ball", "part", "home", "sub"]
        asks = cells.select(*[F.col(c).alias(f"q_{c}") for c in keys], "query_id", "vector", "floor")
        return moved.groupBy(*keys).cogroup(asks.groupBy(*[f"q_{c}" for c in keys])).applyInPandas(lambda shard, block: _cell(shard, block, k), "query_id long, vec_id long, score long")

    seeds = materialize(search(queries.withColumn("floor", F.lit(float("-inf"))), False), "topk-seeds")
    kth = seeds.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).cast("double").alias("floor"))
    rest = search(queries.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), True)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return seeds.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
