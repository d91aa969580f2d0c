import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from crystals import frame, rotated, shape, stacked_cubes, structure_one

from latticework.operators import cages, neighbors, order, rings


def analysed(points):
    edges = neighbors.oo_edges(points).cache()
    found = rings.find_rings(edges).cache()
    return edges, found, cages.find_cages(found).cache()


def sizes(found):
    return {r["size"]: r["count"] for r in found.groupBy("size").count().collect()}


@pytest.mark.parametrize(
    ("number", "edges", "ring_counts", "kind", "isomer"),
    [(0, 12, {4: 6, 6: 4}, "4^6", None), (1, 18, {4: 6, 6: 2}, "4^6-6^2", "2x6sep"), (2, 30, {5: 12}, "512", None), (3, 36, {4: 6, 6: 8}, "4^6-6^8", "6n8e12d33333333")],
)
def test_polyhedra(spark, number, edges, ring_counts, kind, isomer):
    points = frame(spark, rotated(shape(number)))
    e, found, shells = analysed(points)
    assert e.count() == edges and sizes(found) == ring_counts
    assert [(r.cage_type, len(r.waters)) for r in shells.collect()] == [(kind, len(shape(number)))]
    assert [r.isomer for r in cages.isomers(shells, found).collect()] == [isomer]


def test_polyhedron_across_the_border(spark):
    moved = [((x + 2.9) % 3.0, y % 3.0, z % 3.0) for x, y, z in shape(2)]
    _, found, shells = analysed(frame(spark, moved, 3.0))
    assert sizes(found) == {5: 12} and shells.count() == 1
    center = cages.cage_centers(shells, frame(spark, moved, 3.0)).first()
    assert abs((center.cx - 2.9 + 1.5) % 3.0 - 1.5) < 1e-9


def test_stacked_cubes_share_a_face(spark):
    points = frame(spark, stacked_cubes())
    edges, found, shells = analysed(points)
    assert edges.count() == 20 and sizes(found) == {4: 11, 6: 8}
    assert sorted(r.cage_type for r in shells.collect()) == ["4^6", "4^6"]
    assert cages.shared_faces(shells).count() == 1
    assert {r["size"] for r in cages.clusters(shells).collect()} == {2}


def test_f3_of_cube_and_dodecahedron(spark):
    for number, value in ((0, 0.0123427), (2, 0.000243554)):
        points = frame(spark, shape(number))
        got = [r.f3 for r in order.f3(points, neighbors.oo_edges(points)).collect()]
        assert all(abs(v - value) < 1e-6 for v in got)


def test_guest_inside_and_outside(spark):
    points = frame(spark, shape(2))
    _, found, shells = analysed(points)
    guests = frame(spark, [(0.0, 0.0, 0.0), (0.05, 0.0, 0.05), (1.0, 0.0, 0.0), (0.45, 0.0, 0.0)])
    held = cages.occupancy(shells, found, points, guests)
    assert sorted(r.guest for r in held.collect()) == [0, 1]
    assert sorted(r.guest for r in cages.occupancy(shells, found, points, guests, mode="auto").collect()) == [0, 1, 3]


def test_structure_one_crystal(spark):
    coordinates, box = structure_one(2)
    points = frame(spark, coordinates, box)
    edges, found, shells = analysed(points)
    assert edges.count() == 2 * len(coordinates)
    assert sizes(found) == {5: 384, 6: 48}
    assert {r.cage_type: r["count"] for r in shells.groupBy("cage_type").count().collect()} == {"512": 16, "51262": 48}
    assert {r.isomer for r in cages.isomers(shells, found).where("cage_type = '51262'").collect()} == {"2x6sep"}
    support = cages.phase_support(shells, found).where("phase = 'sI'").collect()
    assert len(support) == 64 and all(r.strict and r.score == 1.0 for r in support)
    assert cages.clusters(shells).select("cluster").distinct().count() == 1


def test_empty_input(spark):
    points = frame(spark, [(0.0, 0.0, 0.0)]).limit(0)
    edges, found, shells = analysed(points)
    assert (edges.count(), found.count(), shells.count()) == (0, 0, 0)


def with_box(found, points):
    box = points.select("group_key", "frame_index", "lx", "ly", "lz").distinct()
    return rings.ring_centers(found, points).join(box, ["group_key", "frame_index"])


def test_patches_of_polyhedra(spark):
    from latticework.operators import patches

    points = frame(spark, shape(2))
    _, found, shells = analysed(points)
    got = patches.find_patches(found, with_box(found, points)).cache()
    assert {(r.patch_type, r.kind): r["count"] for r in got.groupBy("patch_type", "kind").count().collect()} == {("hc_5r_5⁵", "half"): 12}
    assert patches.free_patches(got, shells).count() == 0
    points = frame(spark, shape(3))
    _, found, _ = analysed(points)
    got = patches.find_patches(found, with_box(found, points), base_sizes=(4, 6), side_sizes=(4, 6))
    assert {(r.patch_type, r.kind): r["count"] for r in got.groupBy("patch_type", "kind").count().collect()} == {("qc_4r_6⁴₆₆₆₆", "quasi"): 6, ("qc_6r_4³6³₄₆₄₆₄₆", "quasi"): 8}


def test_phases_of_structure_one(spark):
    from latticework.operators import patches, phases

    coordinates, box = structure_one(2)
    points = frame(spark, coordinates, box)
    _, found, shells = analysed(points)
    rows = phases.phase_domains(shells, found).collect()
    assert {(r.phase, r.status) for r in rows} == {("sI", "classified")} and len({r.domain for r in rows}) == 1
    lone = phases.phase_domains(shells.where("cage_id = '512_00001'"), found).collect()
    assert [(r.phase, r.status) for r in lone] == [(None, "unclassified")]
    got = {r.patch_type: r["count"] for r in patches.find_patches(found, with_box(found, points)).groupBy("patch_type").count().collect()}
    assert got["hc_5r_5⁵"] > 0 and got["hc_6r_5⁶"] == 96


def test_composite_seed_makes_a_domain(spark):
    from latticework.operators import phases

    names = {"L": "51268", "R": "51268"} | {f"S{k}": "512" for k in range(6)} | {f"M{k}": "435663" for k in range(6)}
    ties = [(x, f"S{k}", 5) for x in "LR" for k in range(6)] + [("L" if k < 3 else "R", f"M{k}", 6) for k in range(6)] + [(f"S{k}", f"M{k}", 5) for k in range(6)] + [("M0", "M3", 4)]

    def domains(ties):
        found = spark.createDataFrame([("A", 0, f"ring{n}_{k:05d}", n, [k]) for k, (_, _, n) in enumerate(ties)], "group_key string, frame_index int, ring_id string, size int, nodes array<long>")
        own = {c: [f"ring{n}_{k:05d}" for k, (a, b, n) in enumerate(ties) if c in (a, b)] for c in names}
        shells = spark.createDataFrame([("A", 0, c, t, own[c], [0]) for c, t in names.items()], "group_key string, frame_index int, cage_id string, cage_type string, rings array<string>, waters array<long>")
        return {(r.phase, r.status) for r in phases.phase_domains(shells, found).collect()}

    assert domains(ties) == {("sH", "classified")}
    assert domains(ties[:-1]) == {(None, "unclassified")}


def test_ring_and_cage_geometry(spark):
    from latticework.operators import geometry

    points = frame(spark, [((x + 2.9) % 3.0, y % 3.0, z % 3.0) for x, y, z in rotated(shape(0))], 3.0)
    _, found, shells = analysed(points)
    rows = geometry.ring_geometry(found, points).collect()
    squares = [r for r in rows if r.ring_id.startswith("ring4")]
    assert all(r.planarity < 1e-9 and r.edge_cv < 1e-9 and abs(r.area - 0.28**2) < 1e-9 for r in squares) and len(squares) == 6
    assert all(r.planarity > 0.05 for r in rows if r.ring_id.startswith("ring6"))
    assert abs(geometry.cage_volumes(shells, found, points).first().volume - 0.28**3) < 1e-9
    assert geometry.sound_cages(shells, found, points).count() == 1 and geometry.sound_cages(shells, found, points, volume=1.0).count() == 0


def test_sound_cages_and_rims_are_found_once(spark):
    from latticework.plans import polyhedra, reports

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan(polyhedra.cage_volumes(spark, "/root/testdata/sf0.001"))  # the shapes of rings are not measured again
    assert "to_json" not in plan(reports.closed_pairs(spark, "/root/testdata/sf0.001"))  # digests of rims are not made for each side of the join
