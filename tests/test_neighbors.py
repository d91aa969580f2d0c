import random

import pytest

from latticework.operators import neighbors

POINT = "group_key string, frame_index int, node long, x double, y double, z double, lx double, ly double, lz double"


def brute(rows, cutoff):
    out = {}
    for g, f, u, *p in rows:
        for h, e, v, *q in rows:
            if (g, f) == (h, e) and u < v:
                d = [b - a if n is None else (b - a) - n * round((b - a) / n) for a, b, n in zip(p[:3], q[:3], p[3:], strict=True)]
                if sum(x * x for x in d) <= cutoff * cutoff:
                    out[g, f, u, v] = tuple(d)
    return out


def sample():
    """Sparse, crowded, wrapped, narrow, endless and mixed boxes, with points on block bounds and beyond the box."""
    rng = random.Random(4)
    rows = []
    boxes = [(1, 1, 1), (0.35, 1, 7), (None,) * 3, (2, None, 0.9), (40, 40, 40), (1, 1, 1)]
    for f, box in enumerate(boxes):
        for k in range(150):
            at = [rng.choice([rng.uniform(-1, 2), rng.gauss(0.5, 0.05), 0.2 * rng.randrange(6), 5e4 + rng.random()]) if n != 40 else 40 * rng.random() for n in box]
            rows.append(("AB"[f % 2], f, k * (-1) ** k, *at, *map(lambda n: None if n is None else float(n), box)))
    return rows


@pytest.mark.parametrize(("points", "leaf", "tried"), [(1 << 16, 64, 1 << 19), (1, 2, 1), (100, 8, 50)])
def test_pairs_match_brute_force(spark, monkeypatch, points, leaf, tried):
    for name, value in (("POINTS", points), ("LEAF", leaf), ("TRIED", tried)):
        monkeypatch.setattr(neighbors, name, value)
    rows = sample()
    frame = spark.createDataFrame(rows, POINT)
    want = brute(rows, 0.2)
    for made in (neighbors.self_cutoff_pairs(frame, 0.2), neighbors.oo_edges(frame, 0.2)):
        got = [((r.group_key, r.frame_index, r.u, r.v), (r.dx, r.dy, r.dz)) for r in made.collect()]
        assert len(got) == len(dict(got)) and len(got) > 1000
        differ = {k for k in dict(got).keys() ^ want.keys()}
        assert all(abs(sum(x * x for x in (want.get(k) or dict(got)[k])) - 0.04) < 1e-12 for k in differ)  # rounding at the bound
        assert all(d == pytest.approx(want[k], abs=1e-12) for k, d in got if k in want)


def test_pairs_are_not_shuffled(spark):
    frame = spark.createDataFrame(sample(), POINT)
    plan = neighbors.oo_edges(frame, 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert neighbors.oo_edges(frame.limit(0), 0.2).collect() == []
