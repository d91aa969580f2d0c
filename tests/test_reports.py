import pytest

from latticework import cli
from latticework.operators import reports
from latticework.sources import lammps

DATA = """test

5 atoms
{tilt}
0 10 xlo xhi
0 10 ylo yhi
0 20 zlo zhi

Masses

1 15.9994
2 1.008
3 12.011

Atoms # full

1 {m1} 1 -0.8 1 2 3
2 {m1} 2 0.4 1 2 4
3 {m1} 2 0.4 1 3 3
4 {m2} 3 0.0 5 5 5
5 {m3} {t5} 0.0 6 6 6

Bonds

1 1 1 2
2 1 1 3
"""


@pytest.mark.parametrize("ids", [(1, 2, 3), (0, 0, 0)])
def test_types_by_mass_and_molecule(spark, ids):
    text = DATA.format(tilt="", m1=ids[0], m2=ids[1], m3=ids[2], t5=3)
    topology = lammps.read_data(text)
    assert topology.box[2] == (0.0, 2.0) and topology.atoms[0][3:] == pytest.approx((0.1, 0.2, 0.3))
    got = {(r.type, r.resname, r.atomname) for r in lammps.infer_types(spark, topology).collect()}
    assert got == {("1", "SOL", "OW"), ("2", "SOL", "HW1"), ("3", "CH4", "C")}
    with pytest.raises(Exception, match="several roles"):
        lammps.infer_types(spark, lammps.read_data(DATA.format(tilt="", m1=1, m2=2, m3=3, t5=2))).collect()


def test_tilted_boxes_are_refused():
    with pytest.raises(lammps.FormatError):
        lammps.read_data(DATA.format(tilt="1 0 0 xy xz yz", m1=1, m2=2, m3=3, t5=3))


def test_precursors_and_history(spark):
    key = ("A",)
    edges = spark.createDataFrame([(*key, 0, 1, 2), (*key, 1, 1, 2), (*key, 1, 2, 3), (*key, 2, 1, 2), (*key, 2, 2, 3), (*key, 2, 1, 3), (*key, 3, 1, 2)], "group_key string, frame_index int, u long, v long")
    seen = spark.createDataFrame([(*key, 3, "t1", "512", [1, 2, 3])], "group_key string, frame_index int, track string, cage_type string, waters array<long>")
    found = spark.createDataFrame([(*key, 2, [1, 2, 3]), (*key, 1, [1, 2, 9])], "group_key string, frame_index int, waters array<long>")
    rows = reports.precursors(seen, "t1", edges, {"ring": found}).orderBy("frame_index").collect()
    assert [(r.bonds, r.largest, r.state) for r in rows] == [(1, 2, "dispersed"), (2, 3, "connected"), (3, 3, "ring")]
    points = spark.createDataFrame([(*key, f, n, 0.0, 0.0, 0.0) for f in range(4) for n in range(1, 5)], "group_key string, frame_index int, node long, x double, y double, z double")
    history = {(r.frame_index, r.node): r.degree for r in reports.water_history(seen, "t1", edges, points).collect()}
    assert len(history) == 12 and history[1, 2] == 2 and history[0, 3] == 0
    assert reports.select_targets(seen, "t1").count() == reports.select_targets(seen, "512").count() == 1 and reports.select_targets(seen, "t2").count() == 0


def test_command_line(spark, tmp_path):
    cli.main(["init", str(tmp_path / "config.json")])
    with pytest.raises(FileExistsError):
        cli.main(["init", str(tmp_path / "config.json")])
    rows = "".join(f"{n + 1:5d}{'SOL':<5}{'OW':>5}{n + 1:5d}{x:8.3f}{y:8.3f}{z:8.3f}\n" for n, (x, y, z) in enumerate([(a * 0.28, b * 0.28, c * 0.28) for a in (0, 1) for b in (0, 1) for c in (0, 1)]))
    (tmp_path / "cube.gro").write_text(f"cube\n8\n{rows}0 0 0\n")
    cli.main(["analyze", str(tmp_path / "cube.gro"), str(tmp_path / "out"), "--config", str(tmp_path / "config.json"), "--format", "csv"])
    assert spark.read.csv(str(tmp_path / "out" / "cages"), header=True).first().cage_type == "4^6"
