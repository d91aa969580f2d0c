"""Cages cut into blocks, faces of several cages, further layers of patches: each against a plain restatement."""

import sys
from itertools import combinations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from crystals import frame, shape, structure_one

from latticework.operators import cages, neighbors, patches, rings


def found_rings(points):
    return rings.find_rings(neighbors.oo_edges(points).cache()).cache()


def test_blocks_find_the_same_cages(spark):
    coordinates, box = structure_one(3)
    open_box = [c for c in coordinates if c[0] < 2.2]
    for points in (frame(spark, coordinates, box), frame(spark, open_box)):
        found = found_rings(points)
        want = {(r.cage_type, tuple(r.waters)) for r in cages.find_cages(found).collect()}
        got = cages.find_cages(found, max_faces=14, points=points, block_rings=300)
        assert want and {(r.cage_type, tuple(r.waters)) for r in got.collect()} == want
        assert got.count() == len(want)


def test_a_block_search_uses_several_tasks(spark):
    coordinates, box = structure_one(3)
    points = frame(spark, coordinates, box)
    found = found_rings(points)
    numbered = found.selectExpr("group_key", "frame_index", "1L AS component", "cast(hash(ring_id) AS bigint) AS node", "ring_id", "nodes")
    sides = rings.ring_edges(found).join(numbered.select("group_key", "frame_index", "ring_id", "node"), ["group_key", "frame_index", "ring_id"])
    first = sides.groupBy("group_key", "frame_index", "u", "v").agg({"node": "min"}).withColumnRenamed("min(node)", "first")
    touch = sides.join(first, ["group_key", "frame_index", "u", "v"]).where("node <> first").selectExpr("group_key", "frame_index", "first AS u", "node AS v")
    cut = cages._cut(numbered, touch, points, 14, 300)
    assert cut.select("block").distinct().count() == 8 and cut.where("seed").count() == found.count()


def test_a_guard_fails_the_search(spark):
    found = found_rings(frame(spark, shape(2)))
    with pytest.raises(Exception, match="sets of faces"):
        cages.find_cages(found, max_states=2).collect()


def test_cage_labels_and_report_types():
    assert cages.face_counts("51262") == cages.face_counts("5^12-6^2") == cages.face_counts("0-12-2") == (0, 12, 2)
    assert cages.report_types("I, 4^6") == ("512", "51262", "4^6") and cages.report_types("all") is None
    for bad in ("all,512", "x", "7^2", "", "5^12-6^20"):
        with pytest.raises(ValueError):
            cages.report_types(bad)
    with pytest.raises(ValueError, match="rings of"):
        cages.report_types("51262", sizes=(4, 5))


def test_a_face_parts_two_cages_at_most(spark):
    key = ("A", 0)
    shells = spark.createDataFrame([(*key, c, "512", ["ring5_00001"], [k]) for k, c in enumerate(("a", "b", "c", "d"))], "group_key string, frame_index int, cage_id string, cage_type string, rings array<string>, waters array<long>")
    assert cages.shared_faces(shells).count() == 0  # four cages have the ring: not told without geometry
    rows = [("a", 0.3, 0.9, 0.1), ("b", 0.3, 0.99, 0.01), ("c", -0.3, 0.5, 0.2), ("d", -0.2, 0.5, 0.1)]
    sides = spark.createDataFrame([(*key, c, "ring5_00001", s, a, n) for c, s, a, n in rows], "group_key string, frame_index int, cage_id string, ring_id string, signed double, alignment double, lateral double")
    assert [(r.a, r.b) for r in cages.shared_faces(shells, sides).collect()] == [("b", "d")]
    above = sides.where("signed > 0")
    assert cages.shared_faces(shells, above).count() == 0
    assert {r["size"] for r in cages.clusters(shells, sides).collect()} == {1, 2}


def test_sides_of_a_crystal_are_its_shared_faces(spark):
    coordinates, box = structure_one(2)
    points = frame(spark, coordinates, box)
    found = found_rings(points)
    shells = cages.find_cages(found).cache()
    sides = cages.face_sides(shells, found, points)
    plain = {(r.ring_id, r.a, r.b) for r in cages.shared_faces(shells).collect()}
    assert plain and {(r.ring_id, r.a, r.b) for r in cages.shared_faces(shells, sides).collect()} == plain


def plain_layers(ring_nodes, centers, layers, most=6):
    """Ring sets of all patches of a wall and further layers, by enumeration of connected sets."""
    sides = {r: {frozenset((a, b)) for a, b in zip(n, [*n[1:], n[0]], strict=True)} for r, n in ring_nodes.items()}
    walls = set()
    for base, nodes in ring_nodes.items():
        if len(nodes) not in (5, 6):
            continue
        edges = [frozenset((a, b)) for a, b in zip(nodes, [*nodes[1:], nodes[0]], strict=True)]
        options = [[r for r in ring_nodes if r != base and len(ring_nodes[r]) in (5, 6) and sides[r] & sides[base] == {e}] for e in edges]

        def walk(wall, options=options, base=base, edges=edges):
            k = len(wall)
            if k == len(edges):
                if len((sides[wall[-1]] & sides[wall[0]]) - sides[base]) == 1:
                    nodes = set(ring_nodes[base]).union(*(ring_nodes[r] for r in wall))
                    if len(nodes) == sum(len(ring_nodes[r]) for r in wall) - 2 * len(ring_nodes[base]):
                        walls.add((frozenset((base, *wall)), frozenset(wall)))
                return
            for r in options[k]:
                if r not in wall and (not wall or len((sides[wall[-1]] & sides[r]) - sides[base]) == 1):
                    walk([*wall, r])

        walk([])
    out, states = {w for w, _ in walls}, walls
    for _ in range(1, layers):
        grown = set()
        for patch, rim in states:
            count = {}
            for r in patch:
                for e in sides[r]:
                    count[e] = count.get(e, 0) + 1
            open_ = {e for r in rim for e in sides[r] if count[e] == 1}
            lower = {e for r in patch - rim for e in sides[r]}
            near = [r for r in ring_nodes if r not in patch and len(ring_nodes[r]) in (5, 6) and sides[r] & open_ and not sides[r] & lower]
            for n in range(1, min(most, len(near)) + 1):
                for unit in combinations(near, n):
                    part, stack = set(), [unit[0]]
                    while stack:
                        r = stack.pop()
                        if r not in part:
                            part.add(r)
                            stack += [o for o in unit if sides[o] & sides[r]]
                    if len(part) == n:
                        grown.add((patch | set(unit), frozenset(unit)))
        states = grown
        out |= {p for p, _ in grown}
    return out


def test_layers_match_enumeration(spark):
    points = frame(spark, shape(2))
    found = found_rings(points)
    centers = rings.ring_centers(found, points).join(points.select("group_key", "frame_index", "lx", "ly", "lz").distinct(), ["group_key", "frame_index"])
    nodes = {r.ring_id: list(r.nodes) for r in found.collect()}
    got, warnings = patches.patches_and_warnings(found, centers, layers=2, layer_rings=3, layer_states=10_000, exact=True)
    want = plain_layers(nodes, None, 2, most=3)
    rows = got.collect()
    assert {frozenset(r.rings) for r in rows} == want and len(rows) == len(want) and warnings.count() == 0
    assert {r.patch_type for r in rows if r.kind == "half"} == {"hc_5r_5⁵"} and all(r.patch_type.startswith("qc_5r_5⁵₅₅₅₅₅_5") for r in rows if r.kind == "quasi")
    few, limits = patches.patches_and_warnings(found, centers, layers=2, layer_rings=3, layer_states=2, exact=True)
    assert few.count() < len(want) and [r.warning for r in limits.collect()] == ["layer states"]
    with pytest.raises(ValueError):
        patches.find_patches(found, centers, layers=4)


def test_connected_units():
    links = {"a": {"b"}, "b": {"a", "c"}, "c": {"b"}, "d": set()}
    units, limited = patches.connected_units(links, 2, 100, True)
    assert not limited and sorted(units) == [("a",), ("a", "b"), ("b",), ("b", "c"), ("c",), ("d",)]
    assert patches.connected_units(links, 3, 100, False) == ([("a", "b", "c"), ("d",)], False)
    assert patches.connected_units(links, 2, 2, True)[1]


def test_two_domes_close_into_a_shell(spark):
    points = frame(spark, shape(2))
    found = found_rings(points)
    centers = rings.ring_centers(found, points).join(points.select("group_key", "frame_index", "lx", "ly", "lz").distinct(), ["group_key", "frame_index"])
    domes = patches.find_patches(found, centers)
    closed = patches.closed_pairs(domes, found).collect()
    assert len(closed) == 6 and all(len(r.rings) == 12 for r in closed)


def test_rims_by_joins_are_those_of_one_task(spark, monkeypatch):
    coordinates, box = structure_one(2)
    points = frame(spark, coordinates, box)
    found = found_rings(points)
    want = {(r.cage_type, tuple(r.waters)) for r in cages.find_cages(found).collect()}
    monkeypatch.setattr(cages, "RIM_RINGS", 0)
    assert {(r.cage_type, tuple(r.waters)) for r in cages.find_cages(found, max_faces=14, points=points, block_rings=100).collect()} == want
