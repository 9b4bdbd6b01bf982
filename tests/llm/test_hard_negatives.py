import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm.hard_negatives import Candidates, down_the_tree, hard_negatives, spanning_tree
from tablewright.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, v int, anchor string"


def brute(rows, every, n_pos=5, n_neg=3, low=50, high=95):
    seen, able = set(), []
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        whole = tuple(math.floor(256 * x) for x in v)
        if (i, label, whole) not in seen:
            seen.add((i, label, whole))
            able.append((i, label, whole))

    def clip(x):
        return max(-(1 << 63), min((1 << 63) - 1, x))

    out = []
    for i, label, v in able:
        if i % every:
            continue
        scored = [(clip(sum(a * b for a, b in zip(v, w))), j, g) for j, g, w in able if len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == label and s[1] != i][:n_pos]:
            within = [s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p]
            out += [(i, j, k, s[1], p, s[0]) for k, s in enumerate(within[:n_neg], 1)]
    return sorted(out)


def vectors(n, dim, seed, spread=0.6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [
        (i, [c + rng.gauss(0, spread) for c in centres[i % 3]], (i // 3) % 4 if i % 9 else i % 2, "x", 1, "y") for i in range(n)
    ]


@pytest.mark.parametrize(("dim", "anchor_block", "row_block"), [(8, 1024, 8192), (3, 4, 20), (1, 2, 7)])
def test_against_brute_force(spark, dim, anchor_block, row_block):
    rows = vectors(240, dim, dim)
    rows += [(1000 + i, rows[5][1], 1, "x", 1, "y") for i in range(30)] + [rows[10]] * 40
    rows += [(2000, None, 1, "x", 1, "y"), (2050, [], 1, "x", 1, "y"), (2100, [1.0] * (dim - 1) + [None], 1, "x", 1, "y")]
    rows += [(2150, [float("nan")] * dim, 1, "x", 1, "y"), (2200, [1e308] * dim, 1, "x", 1, "y"), (None, [1.0] * dim, 1, "x", 1, "y")]
    rows += [(2250, [1.0] * dim, None, "x", 1, "y"), (2300, [1.0, 2.0] * dim, 1, "x", 1, "y"), (2301, [1.0, 2.0] * dim, 1, "x", 1, "y")]
    rows += [(2302, [0.5, 1.5] * dim, 2, "x", 1, "y"), (2400, [0.0] * dim, 1, "x", 1, "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = hard_negatives(df, F.col("vec_id") % 10 == 0, anchor_block=anchor_block, row_block=row_block)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10)


@pytest.mark.parametrize("size", [1e7, 1e12, 1e150])
def test_large_components(spark, size):
    rows = [(i, [x * size for x in v], g, "x", 1, "y") for i, v, g, *_ in vectors(60, 3, 4)]
    rows += [(100 + i, [x / 50 for x in v], g, "x", 1, "y") for i, v, g, *_ in vectors(30, 3, 5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    found = hard_negatives(df, F.col("vec_id") % 5 == 0, row_block=16, anchor_block=8)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []
    rows = vectors(30, 2, 1)
    assert hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") < 0).collect() == []
    few = [(0, [1.0, 0.0], 1, "x", 1, "y"), (1, [1.0, 0.1], 1, "x", 1, "y"), (2, [0.7, 0.1], 2, "x", 1, "y")]
    found = hard_negatives(spark.createDataFrame(few, SCHEMA), F.col("vec_id") == 0)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 1, 2, 65536, 45824)]


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, v, (g + 1) % 10 if i % 7 == 0 else g) for i, v, g in rows]
    assert sorted(map(tuple, op11_hard_negatives(spark, sf).collect())) == brute(rows, 50)


def test_intervals_hold_and_spare_work():
    rng = np.random.default_rng(1)
    anchors, rows = np.floor(rng.normal(size=(40, 4)) * 5) + 300, np.floor(rng.normal(size=(500, 4)) * 50)
    order, parent, edge = spanning_tree(anchors)
    assert sorted(order) == list(range(40)) and (parent == -1).sum() == 1
    for a in range(40):
        if parent[a] >= 0:
            assert math.isclose(edge[a], np.linalg.norm(anchors[a] - anchors[parent[a]]))
    scored = 0

    def wanted(a, low, high):
        true = rows @ anchors[a]
        assert ((low <= true) & (true <= high)).all()
        return (high >= 30000) & (low <= 31000)

    for a, some, scores in down_the_tree(anchors, Candidates(rows), wanted):
        true = rows @ anchors[a]
        assert (scores == true[some]).all() and set(np.flatnonzero((true >= 30000) & (true <= 31000))) <= set(some)
        scored += len(some)
    assert scored < 40 * 500 / 4
