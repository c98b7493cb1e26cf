"""Exact top-k search against all scores."""

import math

import numpy as np
import pytest

from velado.llm import search

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, shard string, score string"


def brute(rows, every, k=5):
    live = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            live.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, v) in enumerate(live):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(live) if b != a and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **more):
    table = spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA)
    got = search.top_k(table, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("dims,values", [(8, None), (3, [0.0, 0.25, -0.5])])
def test_all_scores(spark, dims, values):
    rng = np.random.default_rng(dims)
    rows = [(i, [float(x) for x in (rng.choice(values, dims) if values else rng.standard_normal(dims))]) for i in range(700)]
    rows += rows[:3] + [(None, [0.0] * dims), (2000, None), (2001, [None] * dims), (2002, [float("nan")] * dims), (2050, [float("inf")] + [0.0] * (dims - 1)), (2100, [1.0, 2.0]), (2101, [3.0, 4.0])]
    assert run(spark, rows, every=10, shard_rows=150, group_rows=20) == brute(rows, 10)


def test_few_and_none(spark):
    assert run(spark, []) == []
    rows = [(0, [1.0, 2.0]), (50, [2.0, 1.0]), (51, [1e9, -1e9])]
    assert run(spark, rows) == brute(rows, 50)
    assert run(spark, [(0, [1.0])]) == []


def test_tree_bounds_hold():
    rng = np.random.default_rng(1)
    points = rng.integers(-100, 100, (1000, 6)).astype(float)
    tree, q = search.KdTree(points, 16), rng.integers(-100, 100, (5, 6)).astype(float)
    bounds = tree.bounds(q)
    for node, (a, b) in enumerate(zip(tree.begin, tree.end)):
        assert ((tree.points[a:b] @ q.T).max(0) <= bounds[:, node] + 1e-9).all()
    assert sorted(tree.order) == list(range(1000))
