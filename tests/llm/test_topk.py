import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import topk

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in good:
        if i % 50 == 0:
            asked[i] = min((v, asked.get(i, v)), key=lambda x: (len(x), x))
    for i, q in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(11)
    near = lambda: rng.choice((-0.5, 0.0, 0.25, rng.gauss(0, 1)))  # noqa: E731 - many ties
    rows = [(i, [float("%.6f" % near()) for _ in range(8)]) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one vector for a quarter of the rows
    rows += [(1500, None), (1550, [None] * 8), (1501, [1.0] * 7 + [None]), (1502, [float("nan")] * 8), (1503, [float("inf")] + [0.0] * 7), (1600, [1.0, 2.0]), (1601, [3.0, 4.0]), (1650, []), (None, [1.0] * 8), (100, rows[3][1]), (150, [1.0, 2.0]), (1600, [0.5] * 8)]
    return [(i, v and [None if x is None else struct_float(x) for x in v]) for i, v in rows]


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("shard,block,pivots", [(8192, 1024, 1024), (100, 7, 1024), (50, 3, 4)])
def test_matches_brute_force(spark, vectors, shard, block, pivots):
    df = spark.createDataFrame(vectors, VECTORS).select("vec_id", topk.quantize(F.col("embedding")).alias("vector"), F.lit(1).alias("rank"), F.lit(2).alias("ball"))
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=shard, block_rows=block, pivots=pivots).collect()))
    assert got == brute(vectors, 5)


def test_large_values_and_few_rows(spark):
    rows = [(0, [3e6, -3e6]), (1, [3e6, 3e6 + 0.01]), (2, [-3e6, 9e6])]
    rows += [(10 + i, [3e6 + i / 256, 3e6 - i / 256]) for i in range(200)]  # scores differ beyond what a double holds
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantize(F.col("embedding")).alias("vector"))
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=40).collect())) == brute(rows, 5)
    assert topk.top_k(df.limit(0), F.lit(True), 5).collect() == []
    assert topk.top_k(df, F.lit(False), 5).collect() == []


def test_balls_are_pruned_before_vectors_move(spark):
    """Groups of vectors in different directions: a query's kth score leaves it few of the balls, and nothing is lost."""
    rng = random.Random(4)
    axes = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [struct_float(x + rng.gauss(0, 0.02)) for x in axes[i % 20]]) for i in range(1200)]
    df = spark.createDataFrame(rows, VECTORS).select("vec_id", topk.quantize(F.col("embedding")).alias("vector"))
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=30).collect())) == brute(rows, 5)
    points = np.array([[math.floor(256 * x) for x in v] for _, v in rows], dtype=np.float64)
    balls = topk._Balls([list(map(int, p)) for p in points[:40]])
    ball, away = balls.nearest(points)
    balls.radii = {int(b): float(away[ball == b].max()) for b in set(ball)}
    queries = points[::50]
    scores = queries @ points.T
    numbers, bounds = balls.bounds(queries)
    for n, b in enumerate(numbers):
        assert (scores[:, ball == b].max(axis=1) <= bounds[:, n]).all()
    kth = np.sort(scores, axis=1)[:, -6]
    assert (bounds >= kth[:, None]).mean() < 0.25


def test_equal_vectors_go_to_several_shards(spark):
    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.lit(3).cast("long"), F.lit(4).cast("long")).alias("vector"))
    got = topk.top_k(df, F.col("vec_id") == 50, 3, shard_rows=500).collect()
    assert sorted(map(tuple, got)) == [(50, 1, 0, 25), (50, 2, 1, 25), (50, 3, 2, 25)]
