import math
import random

import pytest

from tablewright.operators.linkage import components, cut_forest, linked_clusters, merge_heights, near_edges, near_forest, single_linkage, spanning_forest

SCHEMA = "id long, x double, y double"


def find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def kruskal(ids, edges):
    root, out = {i: i for i in ids}, []
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        x, y = find(root, a), find(root, b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b, w))
    return sorted(out), {i: find(root, i) for i in ids}


def pairs(points, radius):
    ids = sorted(points)
    return [(a, b, math.dist(points[a], points[b])) for a in ids for b in ids if a < b and math.dist(points[a], points[b]) <= radius]


def cloud(n, seed, ties=False):
    rng = random.Random(seed)
    place = (lambda: rng.randrange(8) / 2) if ties else (lambda: rng.random() * 4)
    return {3 * i: (place(), place()) for i in range(n)}


@pytest.mark.parametrize("block_rows", [1024, 6])
@pytest.mark.parametrize("ties", [False, True])
def test_forest_against_kruskal(spark, block_rows, ties):
    points = cloud(150, 1, ties)
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], SCHEMA).repartition(3)
    edges = near_edges(df, "id", ["x", "y"], 0.6, block_rows)
    every = pairs(points, 0.6)
    assert edges.count() < len(every)
    want, labels = kruskal(points, every)
    found = sorted((r.a, r.b, r.weight) for r in spanning_forest(edges).collect())
    assert [f[:2] for f in found] == [w[:2] for w in want] and [f[2] for f in found] == pytest.approx([w[2] for w in want])
    got = {r.id: r.cluster for r in single_linkage(df, "id", ["x", "y"], 0.6).collect()}
    assert got == labels


def test_cuts_by_height_and_by_number(spark):
    points = cloud(60, 2)
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], SCHEMA)
    for height in (0.2, 0.5):
        got = {r.id: r.cluster for r in single_linkage(df, "id", ["x", "y"], 0.8, height=height).collect()}
        assert got == kruskal(points, pairs(points, height))[1]
    forest, labels = kruskal(points, pairs(points, 9.0))
    left = sorted(forest, key=lambda e: (e[2], e[0], e[1]))[: 60 - 7]
    got = {r.id: r.cluster for r in single_linkage(df, "id", ["x", "y"], 9.0, clusters=7).collect()}
    assert got == kruskal(points, left)[1] and len(set(got.values())) == 7
    with pytest.raises(ValueError, match="radius"):
        single_linkage(df, "id", ["x", "y"], 0.5, height=0.6)


def test_three_columns_one_column_and_copies(spark):
    rng = random.Random(3)
    data = [(i, rng.random() * 3, rng.random() * 3, rng.random() * 3) for i in range(80)] + [(200 + i, 1.0, 1.0, 1.0) for i in range(40)]
    df = spark.createDataFrame(data, "id long, x double, y double, z double")
    points = {d[0]: d[1:] for d in data}
    got = {r.id: r.cluster for r in single_linkage(df, "id", ["x", "y", "z"], 0.5).collect()}
    assert got == kruskal(points, pairs(points, 0.5))[1]
    line = {i: p[:1] for i, p in points.items()}
    forest = spanning_forest(near_edges(df, "id", ["x"], 0.2, 16))
    want = sorted(w for _, _, w in kruskal(line, pairs(line, 0.2))[0])
    steps = merge_heights(forest).orderBy("step").collect()
    assert [s.weight for s in steps] == pytest.approx(want) and [s.step for s in steps] == list(range(1, len(want) + 1))


def test_gaps_empty_tables_and_repeated_ids(spark):
    data = [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.1, 0.0), (3, None, 0.0), (None, 0.1, 0.0), (4, float("nan"), 0.0), (5, 9.0, 9.0)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.id: r.cluster for r in single_linkage(df, "id", ["x", "y"], 0.5).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert single_linkage(df.limit(0), "id", ["x", "y"], 0.5).collect() == []


def test_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1, 1.0) for i in range(300)]
    star = [(1000, 1001 + i, float(i % 5)) for i in range(300)]
    bad = [(5, 5, 0.1), (None, 5, 0.1), (5, None, 0.1), (1, 7, float("nan")), (1, 0, 3.0)]
    edges = spark.createDataFrame(chain + star + bad, "a long, b long, weight double").repartition(4)
    assert sorted((r.a, r.b, r.weight) for r in spanning_forest(edges).collect()) == sorted(chain + star)
    nodes = spark.createDataFrame([(7777,), (3,), (None,)], "node long")
    found = {r.node: r.component for r in components(nodes, spanning_forest(edges)).collect()}
    assert found == {7777: 7777} | {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1301)}
    whole = cut_forest(nodes, spanning_forest(edges), height=0.5).collect()
    assert {r.node: r.cluster for r in whole}[1001] == 1000


def test_a_line_takes_one_edge_for_each_row_but_the_ends(spark):
    rng = random.Random(5)
    points = {i: (rng.randrange(300) / 10,) for i in range(600)}
    df = spark.createDataFrame([(i, p[0], 0.0) for i, p in points.items()], SCHEMA).repartition(4)
    want = kruskal(points, pairs(points, 0.15))[0]
    found = sorted((r.a, r.b, r.weight) for r in near_edges(df, "id", ["x"], 0.15).collect())
    assert [f[:2] for f in found] == [w[:2] for w in want] and [f[2] for f in found] == pytest.approx([w[2] for w in want])
    assert sorted((r.a, r.b, r.weight) for r in near_forest(df, "id", ["x"], 0.15).collect()) == found


@pytest.mark.parametrize("block_rows", [1024, 2])
@pytest.mark.parametrize("radius", [0.1, 0.3, 0.5])
def test_clusters_by_cells(spark, block_rows, radius):
    points = cloud(300, 7) | {5000 + i: (10 + i % 7 / 100, 10 + i % 11 / 100) for i in range(200)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], SCHEMA).repartition(3)
    got = {r.node: r.cluster for r in linked_clusters(df, "id", ["x", "y"], radius, block_rows).collect()}
    assert got == kruskal(points, pairs(points, radius))[1]


def test_a_fixed_height_asks_for_no_tiles_of_a_full_cell(spark, monkeypatch):
    """Copies of one place were all pairs of blocks before."""
    from tablewright.operators import linkage

    def tiles(*args, **kwargs):
        raise AssertionError("tiles of a cell that is linked anyway")

    monkeypatch.setattr(linkage, "near_edges", tiles)
    df = spark.range(5000).selectExpr("id", "1.0 + id % 10 / 1000 as x", "1.0 as y")
    assert {r.cluster for r in single_linkage(df, "id", ["x", "y"], 0.5).collect()} == {0}
