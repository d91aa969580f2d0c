"""LAMMPS DATA topologies and names for numeric atom types.

A DATA file is a small driver-side text; its atoms and bonds become DataFrames.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.graphs import components
from latticework.sources.files import UNITS, FormatError

# Masses of elements and how far a type's mass may be off.
MASSES = {"H": (1.008, 0.35), "C": (12.011, 0.75), "O": (15.9994, 0.75)}
STYLES = {"full": (1, 2, 4), "molecular": (1, 2, 3), "atomic": (None, 1, 2)}  # places of molecule, type and x
_SECTIONS = ("Masses", "Atoms", "Bonds", "Velocities", "Angles", "Dihedrals", "Impropers")


class Topology(NamedTuple):
    box: tuple[tuple[float, float], ...]
    masses: dict[str, float]
    atoms: list[tuple[int, int | None, str, float, float, float]]
    bonds: list[tuple[int, int]]


def read_data(text: str, style: str = "full", units: str = "real") -> Topology:
    """Box, masses, atoms (id, molecule, type, x, y, z in nm) and bonds of a DATA text; tilted boxes are refused."""
    if style not in STYLES:
        raise FormatError(f"atom styles are {sorted(STYLES)}")
    scale = UNITS[units][0]
    lines = [x.split("#")[0].rstrip() for x in text.splitlines()]
    bounds, section, rows = {}, None, {name: [] for name in _SECTIONS}
    for line in lines[1:]:
        parts = line.split()
        if not parts:
            continue
        if parts[0] in _SECTIONS:
            section = parts[0]
        elif section is None:
            if m := re.fullmatch(r"\s*(\S+)\s+(\S+)\s+([xyz])lo\s+[xyz]hi", line):
                bounds[m[3]] = (float(m[1]) * scale, float(m[2]) * scale)
            elif "xy" in parts and any(float(v) for v in parts[:3]):
                raise FormatError("triclinic boxes are not supported")
        else:
            rows[section].append(parts)
    if set(bounds) != set("xyz") or any(hi <= lo for lo, hi in bounds.values()):
        raise FormatError("a DATA file has bounds of a positive box")
    mol, kind, x = STYLES[style]
    atoms = [(int(r[0]), None if mol is None else int(r[mol]), r[kind], *[float(v) * scale for v in r[x : x + 3]]) for r in rows["Atoms"]]
    if len({a[0] for a in atoms}) != len(atoms):
        raise FormatError("atom ids repeat")
    return Topology(tuple(bounds[c] for c in "xyz"), {r[0]: float(r[1]) for r in rows["Masses"]}, atoms, [(int(r[2]), int(r[3])) for r in rows["Bonds"]])


def element(mass: float) -> str | None:
    return next((e for e, (m, off) in MASSES.items() if abs(mass - m) <= off), None)


def infer_types(spark: SparkSession, topology: Topology) -> DataFrame:
    """(type, resname, atomname) by what molecules are made of; a type with two roles is an error.

    Molecules are the file's, or the components of its bonds. One O and two H, with both
    bonds if there are any, are water; one C and four H, or a lone C, methane; the rest is
    environment.
    """
    kinds = F.create_map(*[F.lit(v) for t, m in topology.masses.items() for v in (t, element(m) or "X")])
    atoms = spark.createDataFrame(topology.atoms, "id long, molecule long, type string, x double, y double, z double").withColumn("element", F.coalesce(F.try_element_at(kinds, F.col("type")), F.lit("X")))
    bonds = spark.createDataFrame([("A", 0, min(b), max(b)) for b in topology.bonds], "group_key string, frame_index int, u long, v long")
    if all(a[1] in (None, 0) for a in topology.atoms):
        nodes = atoms.select(F.lit("A").alias("group_key"), F.lit(0).alias("frame_index"), F.col("id").alias("node"))
        atoms = atoms.drop("molecule").join(components(nodes, bonds).select(F.col("node").alias("id"), F.col("component").alias("molecule")), "id")
    end = lambda c, e: atoms.select(F.col("id").alias(c), F.col("element").alias(e), F.col("molecule").alias(f"m{c}"))
    oh = bonds.join(end("u", "a"), "u").join(end("v", "b"), "v").where("array_sort(array(a, b)) = array('H', 'O')").groupBy(F.col("mu").alias("molecule")).agg(F.count("*").alias("oh"))
    sums = atoms.groupBy("molecule").agg(F.count("*").alias("n"), *[F.count_if(F.col("element") == e).alias(e) for e in MASSES]).join(oh, "molecule", "left")
    bonded = F.lit(not topology.bonds) | (F.coalesce("oh", F.lit(0)) == 2)
    role = F.when((F.col("n") == 3) & (F.col("O") == 1) & (F.col("H") == 2) & bonded, "SOL").when((F.col("C") == 1) & (((F.col("n") == 5) & (F.col("H") == 4)) | (F.col("n") == 1)), "CH4").otherwise("ENV")
    roles = atoms.join(sums.select("molecule", role.alias("resname")), "molecule").groupBy("type").agg(F.min("resname").alias("resname"), F.countDistinct("resname").alias("n"), F.first("element").alias("element"))
    conflict = F.raise_error(F.concat(F.lit("atom type with several roles: "), "type"))
    name = F.when((F.col("resname") == "SOL") & (F.col("element") == "O"), "OW").when(F.col("resname") == "SOL", "HW1").otherwise(F.col("element"))
    return roles.select("type", F.when(F.col("n") > 1, conflict).otherwise(F.col("resname")).alias("resname"), name.alias("atomname"))


