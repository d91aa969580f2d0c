import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from crystals import structure_one

from latticework.session import Config, Session
from latticework.sources import files


def gro(coordinates, box, title="ice t= 5.0", guest=None):
    rows = [f"{n % 99999 + 1:5d}{'SOL':<5}{'OW':>5}{n % 99999 + 1:5d}{x:8.3f}{y:8.3f}{z:8.3f}" for n, (x, y, z) in enumerate(coordinates)]
    if guest:
        rows.append(f"{len(rows) + 1:5d}{'CH4':<5}{'C':>5}{len(rows) + 1:5d}" + "".join(f"{v:8.3f}" for v in guest))
    return "\n".join([title, str(len(rows)), *rows, " ".join([f"{box:.5f}"] * 3)]) + "\n"


def test_gro_to_cages_and_tracks(spark, tmp_path):
    coordinates, box = structure_one(2)
    body = gro(coordinates, box, "a t= 0.0", guest=(0.0, 0.0, 0.0)) + gro(coordinates, box, "b t= 2.0", guest=(0.0, 0.0, 0.0))
    (tmp_path / "run.gro").write_text(body)
    session = Session(spark)
    atoms = session.read_frames(str(tmp_path / "run.gro")).cache()
    assert [tuple(r) for r in atoms.groupBy("frame_index", "time_ps").count().orderBy("frame_index").collect()] == [(0, 0.0, 369), (1, 2.0, 369)]
    tables = session.analyze(atoms)
    rows = tables["summary"].orderBy("frame_index").collect()
    assert [(r.waters, r.edges, r["5"], r["6"], r.cages, r.occupied) for r in rows] == [(368, 736, 384, 48, 64, 1)] * 2
    tracked = session.track(tables, atoms)
    assert tracked["lifetimes"].count() == 64 and tracked["events"].where("kind <> 'birth'").count() == 0


def test_gro_round_trip_and_errors(spark, tmp_path):
    text = gro([(0.1, 0.2, 0.3), (1.0, 2.0, 3.0)], 4.0)
    for k in (2, 10, 1):
        (tmp_path / f"f{k}.gro").write_text(text.replace("0.100", f"0.{k:02d}0"))
    atoms = files.read_frames(spark, str(tmp_path), pattern="*.gro").cache()
    assert [round(r.x, 3) for r in atoms.where("atom = 0").orderBy("frame_index").collect()] == [0.01, 0.02, 0.1]
    lines = [r.line for r in files.gro_lines(atoms.where("frame_index = 0")).orderBy("place").collect()]
    again = list(files.read_gro_text("\n".join(lines)))
    assert again[0][3] == list(files.read_gro_text(text.replace("0.100", "0.010")))[0][3] and again[0][1] == 5.0
    files.write_gro(atoms, str(tmp_path / "out"))
    written = sorted((tmp_path / "out").rglob("part-*"))
    assert len(written) == 3 and all(len(list(files.read_gro_text(w.read_text()))[0][3]) == 2 for w in written)
    for bad, why in ((text.replace("4.00000 4.00000 4.00000", "4 4 4 0 0 1 0 0 0"), "triclinic"), (text.rsplit("\n", 2)[0], "incomplete"), (text + text.replace("SOL", "WAT"), "differ"), (text.replace("0.300", "  nan"), "finite|record")):
        with pytest.raises(files.FormatError, match=why):
            list(files.read_gro_text(bad))
    assert files.gro_atom("1SOL OW 1 0.1 0.2 0.3 ; note")[:7] == (1, "SOL", "OW", 1, 0.1, 0.2, 0.3)


def test_xyz_dump_and_pairs(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("2\nnote\nO 1 2 3\nC 4 5 6\n")
    assert [(r.resname, r.x) for r in files.read_frames(spark, str(tmp_path / "a.xyz")).orderBy("atom").collect()] == [("O", 0.1), ("C", 0.4)]
    dump = "ITEM: TIMESTEP\n10\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 20\nITEM: ATOMS id type xs ys zs\n2 1 0.5 0.5 0.5\n1 2 0 0 0\n"
    (tmp_path / "a.dump").write_text(dump + dump.replace("TIMESTEP\n10", "TIMESTEP\n20"))
    atoms = files.read_frames(spark, str(tmp_path / "a.dump")).cache()
    assert [(r.frame_index, r.time_ps, r.atomid, r.z, r.lz) for r in atoms.orderBy("frame_index", "atom").collect()][:2] == [(0, 0.01, 1, 0.0, 2.0), (0, 0.01, 2, 1.0, 2.0)]
    named = files.apply_type_map(atoms, {"1": ("SOL", "OW"), "2": None})
    assert {(r.resname, r.atomname) for r in named.collect()} == {("SOL", "OW")}
    with pytest.raises(Exception, match="no entry"):
        files.apply_type_map(atoms, {"1": None}).collect()
    for bad in (dump.replace("2 1 0.5", "1 1 0.5"), dump.replace("pp pp pp", "xy xz yz pp pp pp"), dump.replace("NUMBER OF ATOMS\n2", "NUMBER OF ATOMS\n3")):
        with pytest.raises(files.FormatError):
            list(files.read_dump_text(bad))
    (tmp_path / "p.txt").write_text("# pairs\n1 2\n2;1\n3,3\n 4  5 # end\n\n")
    assert sorted(tuple(r) for r in files.read_pairs(spark, str(tmp_path / "p.txt")).collect()) == [(1, 2), (2, 1), (4, 5)]
    (tmp_path / "a.xtc").write_text("binary")
    with pytest.raises(Exception, match="decoder"):
        files.read_frames(spark, str(tmp_path / "a.xtc")).count()


def test_pair_lines_are_read_whole_or_refused(spark, tmp_path):
    (tmp_path / "p.txt").write_text("\ufeff#1 2\n ,7 ,;\t8 ; # 9\n007 8\n8 7#\n7 8\n 5 5\n \t,;\n9223372036854775807 0".lstrip("\ufeff"))
    read = files.read_pairs(spark, str(tmp_path / "p.txt"))
    assert sorted(map(tuple, read.collect())) == [(7, 8), (7, 8), (7, 8), (8, 7), (9223372036854775807, 0)]
    assert "regexp" not in read._jdf.queryExecution().optimizedPlan().toString()  # lines are not matched row by row, several times each
    for bad in ("1", "1 2 3", "1 b", "-1 2", "1.0 2", "9223372036854775808 1"):  # the last was lost without a word
        (tmp_path / "q.txt").write_text(f"1 2\n{bad}\n")
        with pytest.raises(Exception, match="no pair of ids|out of bounds|[Cc]annot|parse"):
            files.read_pairs(spark, str(tmp_path / "q.txt")).collect()


def test_config():
    made = Config.load("oo_cutoff_nm: 0.4\nring_sizes: [5, 6]\ntrack: {gap_frame: 1}\n")
    assert made.ring_sizes == (5, 6) and made.track.gap_frame == 1 and "0.4" in made.resolved()
    for bad in ("nonsense: 1", "mode: other", "ring_sizes: [3]", "track: {min_jaccard: 2}"):
        with pytest.raises(ValueError):
            Config.load(bad)
