"""Readers by split, selection, the wide summary, report tables, sinks, configuration."""

import sys
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from crystals import structure_one
from test_files import gro

from latticework.operators import cages, order, select, tables
from latticework.session import Config, Session
from latticework.sources import files, structures, xlsx

K = ["group_key", "frame_index"]


def test_a_file_of_many_splits(spark, tmp_path):
    points = [[(0.1 * k, 0.2 * f, 0.3) for k in range(20)] for f in range(60)]
    body = "".join(gro(p, 9.0, f"frame t= {f}.0") for f, p in enumerate(points))
    (tmp_path / "run.gro").write_text(body + "\n\n \n")
    dump = "".join(f"ITEM: TIMESTEP\n{f}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 20\nITEM: ATOMS id type x y z\n2 1 1 2 {f}\n1 2 3 4 5\n" for f in range(40))
    (tmp_path / "run.dump").write_text(dump)
    (tmp_path / "notes.txt").write_text("no coordinates")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        atoms = files.read_frames(spark, str(tmp_path)).cache()
        lines = files._numbered_lines(spark, str(tmp_path / "run.gro"), None, False, [".gro"])
        assert lines.rdd.getNumPartitions() > 8
        assert atoms.select("frame_index").distinct().count() == 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    names = {r.frame_index: r.source.rsplit("/", 1)[-1] for r in atoms.select("frame_index", "source").distinct().collect()}
    assert all(names[f] == ("run.dump" if f < 40 else "run.gro") for f in range(100))
    got = {(r.frame_index, r.atom): (r.time_ps, r.x, r.y) for r in atoms.collect()}
    assert all(got[40 + f, k] == (float(f), pytest.approx(0.1 * k, abs=6e-4), pytest.approx(0.2 * f, abs=6e-4)) for f in range(60) for k in (0, 7, 19))
    assert all(got[f, 0][0] == pytest.approx(0.001 * f) for f in range(40))


def test_bad_frames_fail_the_run_or_have_a_row(spark, tmp_path):
    good, bad = gro([(0.1, 0.2, 0.3), (1.0, 2.0, 3.0)], 4.0), gro([(0.1, 0.2, 0.3), (1.0, 2.0, 3.0)], 4.0)
    (tmp_path / "a.gro").write_text(good)
    (tmp_path / "b.gro").write_text(bad.replace("2.000", "  xxx"))
    (tmp_path / "c.gro").write_text("\n".join(bad.split("\n")[:3]))
    (tmp_path / "d.gro").write_text(good + good)
    with pytest.raises(Exception):
        files.read_frames(spark, str(tmp_path)).collect()
    atoms, failed = files.split_failed(files.read_frames(spark, str(tmp_path), lenient=True))
    assert sorted(r.frame_index for r in atoms.select("frame_index").distinct().collect()) == [0, 3, 4]
    rows = failed.orderBy("frame_index").collect()
    assert [(r.frame_index, r.source.rsplit("/", 1)[-1]) for r in rows] == [(1, "b.gro"), (2, "c.gro")] and all(r.error for r in rows)
    (tmp_path / "e.gro").write_text(good + good.replace("SOL", "WAT"))
    with pytest.raises(Exception, match="differ"):
        files.read_frames(spark, str(tmp_path / "e.gro")).collect()
    with pytest.raises(Exception, match="incomplete"):
        files.read_frames(spark, str(tmp_path / "c.gro")).collect()
    with pytest.raises(files.FormatError, match="more than one"):
        files.read_frames(spark, str(tmp_path / "d.gro"), stacked=False)
    with pytest.raises(ValueError, match="no such option"):
        files.read_frames(spark, str(tmp_path / "a.gro"), scale=2.0)


def atoms_of(spark, rows):
    schema = "group_key string, frame_index int, atom int, resid int, resname string, atomname string, molecule_id int"
    return spark.createDataFrame([("A", *r) for r in rows], schema)


def test_molecules_by_id_and_guest_centres(spark):
    atoms = atoms_of(spark, [(0, 0, 1, "CH4", "C", 7), (0, 1, 1, "SOL", "OW", 5), (0, 2, 1, "ch4", "H", 7), (1, 0, 1, "CH4", "C", None), (1, 1, 2, "CH4", "C", None)])
    blocks = select.molecules(atoms)
    assert sorted((r.frame_index, r.atom, r.block) for r in blocks.collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 1), (1, 0, 1), (1, 1, 2)]
    with pytest.raises(Exception, match="with and without"):
        select.molecules(atoms_of(spark, [(0, 0, 1, "A", "X", 1), (0, 1, 1, "A", "X", None)])).collect()
    guests = select.select_guests(blocks, ("CH4",), {"CH4": ("c",)}).orderBy(*K, "block").collect()
    assert [(r.frame_index, r.node, r.atoms, r.center) for r in guests] == [(0, 0, [0, 2], 0), (1, 0, [0], 0), (1, 1, [1], 1)]
    assert {r.center for r in select.select_guests(blocks, ("CH4",), {"CH4": ("C",)}, centroid=True).collect()} == {None}


def test_roles_modes_and_topologies(spark):
    names = spark.createDataFrame([(n,) for n in ("sol", "CH4", "NA", "SDS", "SIO", "X")], "resname string")
    got = [r[0] for r in names.select(select.roles(F.col("resname"), ("SOL",), ("CH4",), ("SDS", "NA"), {"na": "other"}, ("SIO",))).collect()]
    assert got == ["water", "guest", "other", "additive", "environment", "unknown"]
    waters = spark.createDataFrame([("A", 0, [1, 2]), ("A", 1, [1, 2]), ("A", 2, [])], "group_key string, frame_index int, hydrogens array<int>")
    groups = spark.createDataFrame([("A", 0, 1), ("A", 1, 1), ("A", 2, 2)], "group_key string, frame_index int, group int")
    assert {(r.group, r["mode"]) for r in select.graph_modes(waters, groups).collect()} == {(1, "hbond"), (2, "oo")}
    atoms = atoms_of(spark, [(f, k, k, "SOL", "OW", None) for f in range(4) for k in range(2 if f in (0, 2) else 3)])
    found = select.topology(select.residues(atoms))
    assert {(r.frame_index, r.letter) for r in select.topology_letters(found).collect()} == {(0, "A"), (1, "B"), (2, "A"), (3, "B")}
    split = select.by_topology(atoms, found)
    assert {(r.group_key, r.frame_index, r.n) for r in split.groupBy(*K).agg(F.count("*").alias("n")).collect()} == {("A", 0, 2), ("A", 1, 2), ("B", 0, 3), ("B", 1, 3)}
    many = atoms_of(spark, [(f, k, k, "SOL", "OW", None) for f in range(27) for k in range(f + 1)])
    found = select.topology(select.residues(many))
    assert {r.letter for r in select.topology_letters(found).collect()} == {None}
    with pytest.raises(Exception, match="26 topologies"):
        select.by_topology(many, found).collect()


@pytest.mark.parametrize("stretch", [2, 8, 1 << 16])
@pytest.mark.parametrize("kind", ["bigint", "struct<a: bigint, b: int>", "string"])
def test_residues_match_a_walk_along_the_frame_in_stretches(spark, monkeypatch, stretch, kind):
    monkeypatch.setattr(select, "STRETCH", stretch)
    rows, want = [], {}
    for f, group in ((0, "A"), (1, "A"), (1, "B")):
        at, runs, before = -9, 0, None
        for k in range(60):
            at += 1 + (k % 7 == 0) * 9
            now = [("SOL", 1), ("sol", 1), ("CH4", 1), ("CH4", None), (None, None)][(k // (20 if k < 40 else 3) + f) % 5]
            key = (now[0] and now[0].upper(), now[1])
            runs += before != (key,)
            before = (key,)
            atom = (at, k % 2) if kind.startswith("struct") else f"{k:03d}" if kind == "string" else at
            rows.append((group, f, atom, now[1], now[0], "OW"))
            want[group, f, atom] = runs
    atoms = spark.createDataFrame(rows, f"group_key string, frame_index int, atom {kind}, resid int, resname string, atomname string")
    made = select.residues(atoms)
    assert made.columns == [*atoms.columns, "block"]
    assert {(r.group_key, r.frame_index, tuple(r.atom) if kind.startswith("struct") else r.atom): r.block for r in made.collect()} == want
    prints = {(r.group_key, r.frame_index): (r.atoms, r.fingerprint) for r in select.topology(made.where("resname IS NOT NULL")).collect()}
    assert prints["A", 1] == prints["B", 1] != prints["A", 0]


def test_pair_ids(spark):
    waters = spark.createDataFrame([("A", 0, 10, 0), ("A", 0, 11, 3), ("A", 0, 11, 6)], "group_key string, frame_index int, resid int, oxygen int")
    atoms = spark.createDataFrame([("A", 0, k, 100 + k) for k in range(9)], "group_key string, frame_index int, atom int, atomid int")
    pairs = lambda *p: spark.createDataFrame([("A", 0, *x) for x in p], "group_key string, frame_index int, u long, v long")
    got = lambda p, kind: sorted((r.u, r.v) for r in select.pair_nodes(p, waters, atoms, kind).collect())
    assert got(pairs((3, 0), (0, 3), (6, 6)), "oxygen_index") == [(0, 3)] and got(pairs((106, 103)), "atomid") == [(3, 6)] and got(pairs((10, 10)), "resid") == []
    for p, kind, why in ((pairs((10, 11)), "resid", "several"), (pairs((0, 1)), "oxygen_index", "no selected"), (pairs((101, 100)), "atomid", "no selected")):
        with pytest.raises(Exception, match=why):
            got(p, kind)
    with pytest.raises(ValueError):
        select.pair_nodes(pairs((0, 3)), waters, atoms, "name")


def test_order_selections():
    assert order.parameters(None) == ("f3", "f4") and order.parameters("none") == () and order.parameters("all") == order.ALL
    assert order.parameters("dhop-30, q12,Q6, mcg_1, f4") == ("f4", "q6", "q12", "mcg1", "dhop30")
    for bad in ("all,f3", "f5", "q"):
        with pytest.raises(ValueError):
            order.parameters(bad)
    assert order.q_neighbors("lammps") == ("lammps", 12) and order.q_neighbors("oo", "auto") == ("cutoff", None) and order.q_neighbors("nearest", 4) == ("nearest", 4)
    for bad in (("far", None), ("nearest", 0)):
        with pytest.raises(ValueError):
            order.q_neighbors(*bad)


def test_ql_modes_and_shortfalls(spark):
    coordinates, box = structure_one(1)
    points = spark.createDataFrame([("A", 0, n, *map(float, c), box, box, box) for n, c in enumerate(coordinates)], "group_key string, frame_index int, node long, x double, y double, z double, lx double, ly double, lz double")
    from latticework.operators import neighbors

    edges = neighbors.oo_edges(points)
    graph = {r.node: r.q6 for r in order.ql_by_mode(points, edges, (6,)).collect()}
    near = order.ql_by_mode(points, edges.limit(0), (6,), "nearest", 4, 0.35)
    assert {r.node: pytest.approx(graph[r.node]) for r in near.collect()} == {r.node: r.q6 for r in near.collect()}
    assert order.shortfalls(near, 4).count() == 0
    few = order.ql_by_mode(points, edges, (6,), "lammps", None, 0.35)
    assert [(r.short, r.waters) for r in order.shortfalls(few, 12).collect()] == [(46, 46)] and {r.q6 for r in few.collect()} == {0.0}
    assert {r.neighbors for r in order.ql_by_mode(points, edges, (6,), "cutoff", None, 0.5).collect()} != {4}


@pytest.fixture(scope="module")
def analysed(spark, tmp_path_factory):
    coordinates, box = structure_one(2)
    folder = tmp_path_factory.mktemp("frames")
    (folder / "run.gro").write_text(gro(coordinates, box, "a t= 0.0", guest=(0.0, 0.0, 0.0)) + gro(coordinates, box, "b t= 2.0", guest=(0.0, 0.0, 0.0)))
    session = Session(spark, Config.load("", "standard", find_clusters=True, order_parameters="f3,q6,mcg1", focus_waters=(1, 2, 3)))
    atoms = session.read_frames(str(folder / "run.gro")).cache()
    made = session.analyze(atoms)
    failed = spark.createDataFrame([("A", 9, "x", None, "s", "why")], "group_key string, frame_index int, frame string, time_ps double, source string, error string")
    return session, atoms, made, session.report(made, atoms, failed)


def test_the_wide_summary(analysed):
    _, _, _, out = analysed
    rows = out["summary"].orderBy("frame_index").collect()
    assert [(r.status, r.n_atoms, r.n_waters, r.n_guests, r.connection_count, r.oo_connection_count, r.hbond_count, r.coordination_4_fraction) for r in rows[:2]] == [("ok", 369, 368, 1, 736, 736, None, 1.0)] * 2
    assert [(r.ring5, r.ring6, r.free_ring5, r.cage_512, r.cage_51262, r.cage_total, r.cage_empty, r.cage_occupied) for r in rows[:2]] == [(384, 48, 0, 16, 48, 64, 63, 1)] * 2
    assert [(r.hydrate_cluster_count, r.sI_cluster_count, r.sI_domain_count, r.classified_cage_count, r.largest_cluster_cage_count, r.largest_cluster_water_count, r.cluster_size_distribution) for r in rows[:2]] == [(1, 1, 1, 64, 64, 368, "64:1")] * 2
    assert rows[0].F3_count == 368 and rows[0].F3_focus_count == 3 and rows[0].mol_SOL == 368 and rows[0].mol_TOTAL == 369 and rows[0].guest_order == "CH4" and rows[0].MCG1_largest_cluster == 0
    assert rows[2].status == "failed" and rows[2].error == "why" and rows[2].n_atoms is None
    assert [(r.frame_index, r.error) for r in out["failures"].collect()] == [(9, "why")]


def test_report_tables(analysed):
    _, _, made, out = analysed
    assert {r["512"] for r in out["cage"].collect()} == {16} and {r.total for r in out["cage"].collect()} == {64}
    iso = {(r.isomer, r["512"], r["51262"], r.total) for r in out["cage_isomer"].where("frame_index = 0").collect()}
    assert iso == {("plain", "16", "-", 16), ("2x6sep", "-", "48", 48), ("total", "16", "48", 64)}
    assert "F3_focus_mean" in out["order_parameter"].columns and "MCG-1" in out["order_parameter"].columns
    assert out["hydrate_domain"].first().classified_fraction == 1.0 and out["hydrate_cluster_detail"].first().cluster_type == "sI"
    assert {"ring5", "free_ring6"} <= set(out["ring"].columns) and out["molecule"].columns[-2:] == ["CH4", "TOTAL"]
    lines = [r.line for r in tables.markdown_lines(out["ice"]).orderBy("place").collect()]
    assert lines[0].startswith("| group_key") and lines[1] == "|---|---|---|---|---|---|---|" and len(lines) == 5
    info = [r.line for r in tables.info_lines(out["summary"].where("frame_index = 0"), {"Cages": ["cage_512", "F3_mean", "q6_mean"]}).orderBy("place").collect()]
    assert info[0] == "# a t= 0.0" and "cage_512: 16" in info
    assert dict(Config().rows())["track.gap_frame"] == "0" and dict(Config().rows())["ring_sizes"] == "4, 5, 6"
    water = tables.per_water(made["points"], f3=made["f3"], ql=made["ql"])
    assert water.count() == 736 and {"f3", "q6", "q12", "neighbors"} <= set(water.columns)


def test_patch_tables(spark):
    rows = spark.createDataFrame([("A", 0, "hc_5r_5⁵", "half"), ("A", 0, "qc_6r_4³6³₄₆₄₆₄₆", "quasi"), ("A", 0, "qc_6r_4³6³₄₄₄₆₆₆", "quasi"), ("A", 1, "hc_5r_5⁵", "half")], "group_key string, frame_index int, patch_type string, kind string")
    assert [(r["hc_5r_5⁵"], r.total) for r in tables.patch_table(rows, "half").orderBy("frame_index").collect()] == [(1, 1), (1, 1)]
    assert [(r["6r_4³6³"], r.total) for r in tables.patch_table(rows, "quasi").collect()] == [(2, 2)]
    assert {(r.quasi_cage_type, r.isomer, r["count"]) for r in tables.quasi_isomers(rows).collect()} == {("6r_4³6³", "6r_4³6³₄₆₄₆₄₆", 1), ("6r_4³6³", "6r_4³6³₄₄₄₆₆₆", 1)}
    made = {r.frame_index: (r.half_cage_total, r.quasi_cage_total, r.half_cage_breakdown) for r in tables.patch_columns(rows).collect()}
    assert made == {0: (1, 2, "hc_5r_5⁵:1"), 1: (1, 0, "hc_5r_5⁵:1")}
    iso = spark.createDataFrame([("A", 0, "51262", "6adj"), ("A", 1, "51262", "2x6sep"), ("A", 1, "512", None)], "group_key string, frame_index int, cage_type string, isomer string")
    assert tables.isomer_table(iso, ["512", "51262"]).count() == 5 and tables.isomer_table(iso, ["512", "51262"], zero_rows=True).count() == 8


def test_members_for_a_viewer(analysed):
    session, atoms, made, out = analysed
    roles = select.residues(atoms).select(*K, "atom", select.roles(F.col("resname"), ("SOL",), ("CH4",)).alias("role"), "resname")
    shells = made["cages"]
    rows = tables.render_members(made["frames"].select(*K, "time_ps"), cages.cage_centers(shells, made["points"]), out["phases"], made["clusters"], shells, made["held"], made["guests"], atoms, roles, "oo")
    count = {r.record: r["count"] for r in rows.groupBy("record").count().collect()}
    assert len(rows.columns) == 15 and count == {"F": 2, "C": 128, "G": 2, "P": 2, "M": 130}


def test_structures(analysed, tmp_path):
    session, atoms, made, out = analysed
    heads, points = structures.frame_heads(atoms), made["points"]
    from latticework.operators import rings

    centers = rings.ring_centers(made["rings"], points)
    middle = cages.cage_centers(made["cages"], points)
    assert structures.ring_atoms(centers, heads).where("frame_index = 0").count() == 432
    assert structures.cage_atoms(middle, made["occupancy"], heads, "512").count() == 32 and structures.cage_atoms(middle, made["occupancy"], heads, occupied=True).count() == 2
    assert structures.cluster_atoms(middle, made["clusters"], heads).select("atomname").distinct().count() == 1
    assert structures.patch_atoms(out["patches"], centers, heads).count() == out["patches"].count()
    assert structures.ice_atoms(points, made["ice"], heads).count() == made["ice"].where("ice <> 'liquid'").count()
    files.write_gro(structures.annotated(atoms, made["f3"], "f3").where("frame_index = 0"), str(tmp_path / "out"))
    text = next((tmp_path / "out").rglob("part-*")).read_text()
    first = next(files.read_gro_text(text))[3][0]
    assert first[7] == pytest.approx(made["f3"].where("node = 0 AND frame_index = 0").first().f3, abs=1e-4) and first[8] == 0.0
    with pytest.raises(ValueError):
        structures.ring_atoms(centers, heads, "TOOLONG")


def test_tracking_with_phases(analysed):
    session, atoms, made, out = analysed
    tracked = session.track(made, atoms, out["phase_labels"])
    seen = tracked["observations"]
    assert seen.count() == 128 and {tuple(r.phases) for r in seen.collect()} == {("sI",)}
    assert {(r.distance, r.topology_similarity) for r in seen.where("frame_index = 1").collect()} == {(0.0, 1.0)}
    assert tracked["guest_residence"].count() == 1 and tracked["events"].where("kind = 'phase_change'").count() == 0


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a & <b>", True, None), (2, float("nan"), "é", False, "x")], "i int, d double, s string, b boolean, n string")
    path = tmp_path / "out.xlsx"
    xlsx.write_workbook({"one": df, "two": df.limit(0)}, str(path))
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and len(z.namelist()) == 6
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        rows = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).findall(".//m:row", ns)
        cells = [{c.get("r"): "".join(c.itertext()) for c in r} for r in rows]
        assert cells[0]["A1"] == "i" and cells[1] == {"A2": "1", "B2": "2.5", "C2": "a & <b>", "D2": "1"} and cells[2]["C3"] == "é" and "B3" not in cells[2]
        assert [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).findall(".//m:sheet", ns)] == ["one", "two"]
    assert xlsx.column_name(0) == "A" and xlsx.column_name(27) == "AB"
    with pytest.raises(FileExistsError):
        xlsx.write_workbook({"one": df}, str(path))
    for bad in ({"a/b": df}, {"x" * 31 + "1": df, "x" * 31 + "2": df}):
        with pytest.raises(ValueError):
            xlsx.write_workbook(bad, str(tmp_path / "bad.xlsx"))


def test_config_by_section():
    made = Config.load("input: {delta_time_ps: 5, lammps: {units: metal}}\ngraph: {bond_mode: oo, pair_id: atomid}\ncage: {report_types: [I], max_faces: 16}\nquasi_cage: {max_layers: 2}\ntrack: {gap_frame: 2}\n")
    assert (made.delta_time_ps, made.lammps_units, made.mode, made.pair_id, made.report_types(), made.layers, made.track.gap_frame) == (5, "metal", "oo", "atomid", ("512", "51262"), 2, 2)
    assert Config.load("", "rigorous").find_clusters and Config.load("preset: rigorous\ngraph: {bond_mode: oo}\n", min_cage=3).min_cage == 3
    assert Config.load("preset: rigorous\ngraph: {bond_mode: oo}\n").mode == "oo"
    for bad in ("graph: {nonsense: 1}", "pbc: {box_mode: triclinic}", "ring: {sizes: [5], report_sizes: [6]}", "quasi_cage: {max_layers: 4}", "quasi_cage: {enabled: false, max_layers: 2}", "hydrate_order: {mcg_cone_half_angle_deg: 90}", "order: {parameters: f9}", "ice: {min_six_rings: 0}", "output: {types: [cluster-gro]}", "output: {center_resname: TOOLONG}", "input: {lammps: {units: lj}}", "component: {role_map: {X: king}}", "track: {nonsense: 1}", "preset: none", "cage: {report_types: [51268], max_faces: 12}"):
        with pytest.raises(ValueError):
            Config.load(bad)
