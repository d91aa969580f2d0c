import random

import pytest

from latticework.operators import rings


def brute(edges, sizes, chordless):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = set()

    def grow(path):
        for n in near[path[-1]]:
            if n <= path[0] or n in path or (chordless and any(n in near[p] for p in path[1:-1])):
                continue
            ring = [*path, n]
            closes = len(ring) > 2 and n in near[path[0]]
            if closes and len(ring) in sizes and ring[1] < n:
                out.add(tuple(ring))
            if len(ring) < max(sizes) and not (chordless and closes):
                grow(ring)

    for n in near:
        grow([n])
    return out


@pytest.mark.parametrize(("sizes", "chordless"), [((4, 5, 6), True), ((3, 7, 8), True), ((4, 5), False), ((3, 6), False)])
def test_rings_over_several_blocks(spark, monkeypatch, sizes, chordless):
    rng = random.Random(len(sizes))
    rows, want = [], set()
    for frame in range(3):
        ids = rng.sample(range(-3 * rings.BLOCK, 3 * rings.BLOCK), 40)
        edges = {tuple(sorted(rng.sample(ids, 2))) for _ in range(60 + 10 * frame)}
        rows += [("AB"[frame % 2], frame, u, v) for u, v in edges]
        want |= {("AB"[frame % 2], frame, len(r), r) for r in brute(edges, sizes, chordless)}
    edges = spark.createDataFrame(rows, "group_key string, frame_index int, u long, v long")
    got = [(r.group_key, r.frame_index, r.size, tuple(r.nodes)) for r in rings.find_rings(edges, sizes, chordless).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_small_pieces_give_the_same_rings(monkeypatch):
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(90)}
    np = rings.np
    both = sorted([*edges, *((v, u) for u, v in edges)])
    rows = [(np.array([a for a, _ in both]), np.ones(len(both), dtype=int), np.array([b for _, b in both]))]
    for steps, starts, table in ((1, 1, 0), (40, 7, 0), (1 << 18, 64, 100)):
        monkeypatch.setattr(rings, "STEPS", steps)
        monkeypatch.setattr(rings, "STARTS", starts)
        monkeypatch.setattr(rings, "TABLE", table)
        found = [tuple(r.tolist()) for part in rings._search(rows, np.unique(rows[0][0]), (4, 5, 6), True) for r in part]
        assert len(found) == len(set(found)) and set(found) == brute(edges, (4, 5, 6), True)


def test_paths_are_not_shuffled(spark):
    edges = spark.createDataFrame([("A", 0, 1, 2)], "group_key string, frame_index int, u long, v long")
    assert "path" not in rings.find_rings(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert rings.find_rings(edges.limit(0)).collect() == []


def test_nodes_on_six_rings_match_all_rings(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for frame in range(12):
        ids = rng.sample(range(3 * rings.BLOCK), 16 + 2 * frame)
        edges = {tuple(sorted(rng.sample(ids, 2))) for _ in range(24 + 8 * frame)}
        rows += [("AB"[frame % 2], frame, u, v) for u, v in edges]
        on = {n for r in brute(edges, (6,), True) for n in r}
        want |= {("AB"[frame % 2], frame, n) for n in on if sum(n in e for e in edges) == 4}
    edges = spark.createDataFrame(rows, "group_key string, frame_index int, u long, v long")
    assert len(want) > 10 and {tuple(r) for r in rings.on_six_rings(edges).collect()} == want


@pytest.mark.parametrize("cells", [7000, 1 << 22])
def test_a_node_on_many_six_rings_is_found_at_once(monkeypatch, cells):
    monkeypatch.setattr(rings, "CELLS", cells)
    np = rings.np
    wide = 600  # a, c, d, e, b with 600 of each of c, d and e: 2e8 rings
    c, d, e = (np.arange(10 + k * wide, 10 + (k + 1) * wide) for k in range(3))
    pairs = [(0, 1), (0, 2), (0, 3), (0, 4), *((1, x) for x in c), *((2, x) for x in e)]
    near = [(np.array([a]), np.array([1]), np.array([b])) for a, b in pairs]
    near += [(c, np.full(wide, wide), np.tile(d, wide)), (d, np.full(wide, wide), np.tile(e, wide))]
    assert rings._on_six(near, np.array([0])).tolist() == [0]
    near.append((c, np.full(wide, wide), np.tile(e, wide)))  # now all of them have a chord
    assert rings._on_six(near, np.array([0])).tolist() == []
