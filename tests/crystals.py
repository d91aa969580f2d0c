"""Crystals and polyhedra with known rings and cages."""

import itertools
import math

from latticework.sources.adapters import EDGE, shapes

POINTS = "group_key string, frame_index int, node long, x double, y double, z double, lx double, ly double, lz double"


def structure_one(cells):
    """Oxygens of hydrate structure I (cubic, 46 a cell), from its three sites under the group's operations."""
    a = 1.203
    sites = [(0.25, 0.0, 0.5), (0.1841, 0.1841, 0.1841), (0.0, 0.3096, 0.1153)]
    half, found = 0.5, {}
    for x, y, z in sites:
        for sx, sy, sz in itertools.product((1, -1), repeat=3):
            for perm in ((x, y, z), (z, x, y), (y, z, x)):
                p = (sx * perm[0], sy * perm[1], sz * perm[2])
                for q in (p, (half + p[1], half + p[0], half + p[2])):
                    key = tuple(round(c % 1.0, 6) % 1.0 for c in q)
                    found[key] = key
    unit = sorted(found)
    assert len(unit) == 46
    return [((i + x) * a, (j + y) * a, (k + z) * a) for i, j, k in itertools.product(range(cells), repeat=3) for x, y, z in unit], cells * a


def frame(spark, coordinates, box=None, index=0):
    side = (box, box, box)
    return spark.createDataFrame([("A", index, n, *map(float, c), *side) for n, c in enumerate(coordinates)], POINTS)


def shape(number):
    return [tuple(c * EDGE for c in p) for p in shapes()[number][2]]


def stacked_cubes():
    return [(x * EDGE, y * EDGE, z * EDGE) for x, y in itertools.product((0, 1), repeat=2) for z in range(3)]


def rotated(points, turn=0.7):
    c, s = math.cos(turn), math.sin(turn)
    return [(c * x - s * y, s * x + c * y, z) for x, y, z in points]
