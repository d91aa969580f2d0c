import random

import pytest
from pyspark.sql import functions as F

from latticework.operators import graphs, neighbors

EDGES = "group_key string, frame_index int, u long, v long"


def brute(nodes, edges):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (k, u), (_, v) in edges:
        x, y = top((k, u)), top((k, v))
        root[max(x, y)] = min(x, y)
    return {n: top(n)[1] for n in nodes}


def sample(spark, seed):
    rng = random.Random(seed)
    nodes = [(f, n) for f in range(3) for n in range(120)]
    edges = [((f, a), (f, b)) for f in range(3) for a, b in ((rng.randrange(100), rng.randrange(100)) for _ in range(70))]
    edges += [((2, n), (2, n + 1)) for n in range(99)]  # a long path
    frame = spark.createDataFrame([("A", u[0], u[1], v[1]) for u, v in edges], EDGES)
    return nodes, edges, spark.createDataFrame([("A", f, n) for f, n in nodes], "group_key string, frame_index int, node long"), frame


def test_components(spark, monkeypatch):
    for seed, held in ((1, 500_000), (2, 10)):
        monkeypatch.setattr(graphs, "HELD", held)
        nodes, edges, points, frame = sample(spark, seed)
        got = {(r.frame_index, r.node): r.component for r in graphs.components(points, frame.repartition(5)).collect()}
        assert got == brute(nodes, edges)
    assert graphs.components(points, frame.limit(0)).where("node <> component").count() == 0


def test_two_core_and_largest(spark):
    nodes, edges, points, frame = sample(spark, 3)
    got = {(r.frame_index, r.u, r.v) for r in graphs.two_core(graphs.canonical_edges(frame)).collect()}
    want = {(u[0], min(u[1], v[1]), max(u[1], v[1])) for u, v in edges if u != v}
    while True:
        degree = {}
        for f, u, v in want:
            for n in (u, v):
                degree[f, n] = degree.get((f, n), 0) + 1
        less = {e for e in want if degree[e[0], e[1]] > 1 and degree[e[0], e[2]] > 1}
        if less == want:
            break
        want = less
    assert got == want
    few = frame.where("frame_index < 2")
    for held in (graphs.HELD, 1):  # in one task, and round by round
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(graphs, "HELD", held)
            once = graphs.canonical_edges(few)
            assert {(r.frame_index, r.u, r.v) for r in graphs.two_core(once).collect()} == {e for e in want if e[0] < 2}
            assert graphs.two_core(once.select(*graphs.K, F.concat(F.lit("n"), "u").alias("u"), F.concat(F.lit("n"), "v").alias("v"))).count() == len({e for e in want if e[0] < 2})
    labels = brute(nodes, edges)
    for r in graphs.largest_component(graphs.components(points, frame)).collect():
        parts = {}
        for (f, n), c in labels.items():
            if f == r.frame_index:
                parts.setdefault(c, []).append(n)
        best = min(parts.items(), key=lambda p: (-len(p[1]), p[0]))
        assert r.members == sorted(best[1]) and r["size"] == len(best[1])


@pytest.mark.parametrize("held", [2_000_000, 1])
def test_core_of_points_is_that_of_their_edges(spark, monkeypatch, held):
    monkeypatch.setattr(graphs, "HELD", held)
    rng = random.Random(4)
    rows = [("A", f, n, *(rng.random() for _ in range(3)), *[1.0] * 3) for f in range(2) for n in range(90)]
    rows += [("A", 0, 200 + n, 5 + n * 0.2, 0.0, 0.0, None, None, None) for n in range(7)]  # a chain, which peels from its ends
    points = spark.createDataFrame(rows, "group_key string, frame_index int, node long, x double, y double, z double, lx double, ly double, lz double")
    edges = neighbors.oo_edges(points, 0.21)
    want = sorted((r.frame_index, r.u, r.v) for r in graphs.two_core(edges).collect())
    got = sorted((r.frame_index, r.u, r.v) for r in graphs.core_within(points, 0.21).collect())
    assert got == want and 20 < len(want) < edges.count() - 6
