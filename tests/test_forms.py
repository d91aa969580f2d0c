import random

import pytest
from crystals import shape

from latticework.operators import cages, neighbors, patches, rings


def test_a_form_is_searched_once(monkeypatch):
    searched = []
    plain = cages.closed_shells
    monkeypatch.setattr(cages, "closed_shells", lambda *a: searched.append(a) or plain(*a))
    monkeypatch.setattr(cages, "_FORMS", {})
    square = [(0, 1, 3, 2), (0, 1, 5, 4), (0, 2, 6, 4), (1, 3, 7, 5), (2, 3, 7, 6), (4, 5, 7, 6)]
    one = cages._shells(square, list(range(6)), 20, 0)
    two = cages._shells([tuple(640 + 3 * n for n in r) for r in square], list(range(6)), 20, 0)
    assert len(searched) == 1 and one == [("4^6", list(range(8)), tuple(range(6)))] and two == [("4^6", [640 + 3 * n for n in range(8)], tuple(range(6)))]
    assert cages._shells(square[:5], list(range(5)), 20, 0) == [] and len(searched) == 2
    monkeypatch.setattr(cages, "FORM_RINGS", 0)
    assert cages._shells(square, list(range(6)), 20, 0) == one and len(searched) == 3


def _rows(made):
    found, warnings = made
    return sorted((r.frame_index, r.patch_id, r.patch_type, r.kind, tuple(r.rings)) for r in found.collect()), sorted(map(tuple, warnings.collect()))


@pytest.mark.parametrize("bounds", [
    {"layers": 2, "layer_rings": 2, "layer_states": 10_000, "exact": True},
    {"layers": 3, "layer_rings": 2, "layer_states": 3, "layer_candidates": 3, "per_side": 1},
    {"layers": 2, "base_sizes": (4, 5, 6), "side_sizes": (4, 5, 6), "per_side": 2, "layer_rings": 3, "layer_states": 20, "exact": True},
])
def test_patches_of_whole_components_are_those_by_joins(spark, monkeypatch, bounds):
    rng = random.Random(3)
    rows = [("A", k, n, *p) for k, s in ((0, 2), (1, 3)) for n, p in enumerate(shape(s))]
    for k in (2, 3):  # dodecahedra with more waters among them, so that sides have several rings
        rows += [("A", k, n, *p) for n, p in enumerate(shape(2))]
        rows += [("A", k, 100 + n, *(rng.uniform(-0.4, 0.4) for _ in "xyz")) for n in range(5)]
    points = spark.createDataFrame([(*r, 3.0, 3.0, 3.0) for r in rows], "group_key string, frame_index int, node long, x double, y double, z double, lx double, ly double, lz double")
    found = rings.find_rings(neighbors.oo_edges(points)).cache()
    centers = rings.ring_centers(found, points).join(points.select("group_key", "frame_index", "lx", "ly", "lz").distinct(), ["group_key", "frame_index"])
    centers = centers.where("frame_index <> 3 OR ring_id <> 'ring5_00002'").cache()  # one has no centre
    monkeypatch.setattr(patches, "WHOLE_RINGS", 0)
    want = _rows(patches.patches_and_warnings(found, centers, **bounds))
    monkeypatch.setattr(patches, "WHOLE_RINGS", 10**6)
    got = _rows(patches.patches_and_warnings(found, centers, **bounds))
    assert got == want and len({r[0] for r in want[0]}) > 1
    assert sorted(map(tuple, patches.find_patches(found, centers, **bounds).select("frame_index", "patch_id").collect())) == [r[:2] for r in want[0]]


def test_layers_find_no_cages_and_join_no_small_components(spark, monkeypatch):
    from latticework.plans import reports

    monkeypatch.setattr(cages, "find_cages", lambda *a, **k: pytest.fail("cages are not asked for"))
    monkeypatch.setattr(patches, "_by_joins", lambda *a, **k: pytest.fail("components are small"))
    assert reports.layered_patches(spark, "/root/testdata/sf0.001").count() > 0
