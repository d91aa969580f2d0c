"""Cages of ideal hydrate crystals with faults, made from the driver's tables.

Sites are integer coordinates in units of a fraction of the cell; two cages share a face if
their types and the squares of their distance say so. A hexagonal lattice counts the plane
(x, y at 120 degrees) and the axis apart; a cubic one has no axial distance.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.graphs import K
from latticework.sources.adapters import table

_FCC = ((0, 0, 0), (0, 4, 4), (4, 0, 4), (4, 4, 0))
#: By phase: cells a side, units of a cell, hexagonal or not.
CELLS = {"sI": (3, (4, 4, 4), False), "sII": (2, (8, 8, 8), False), "sH": (3, (6, 6, 2), True)}
#: By phase: cage type and place of each site of a cell.
SITES = {
    "sI": [("512", (0, 0, 0)), ("512", (2, 2, 2))] + [("51262", p) for p in ((1, 2, 0), (3, 2, 0), (0, 1, 2), (0, 3, 2), (2, 0, 1), (2, 0, 3))],
    "sII": [(t, tuple((a + b) % 8 for a, b in zip(p, f, strict=True))) for t, p in (("51264", (1, 1, 1)), ("51264", (7, 3, 3)), ("512", (4, 4, 4)), ("512", (2, 6, 0)), ("512", (6, 0, 2)), ("512", (0, 2, 6))) for f in _FCC],
    "sH": [("51268", (0, 0, 1)), ("435663", (2, 4, 1)), ("435663", (4, 2, 1)), ("512", (3, 0, 0)), ("512", (0, 3, 0)), ("512", (3, 3, 0))],
}
#: Phase, two types in order, squared distance in the plane (in all, if cubic), distance along the axis, sides of the face.
RULES = [
    ("sI", "512", "51262", 5, 0, 5), ("sI", "51262", "51262", 4, 0, 6), ("sI", "51262", "51262", 6, 0, 5),
    ("sII", "512", "512", 8, 0, 5), ("sII", "512", "51264", 11, 0, 5), ("sII", "51264", "51264", 12, 0, 6),
    ("sH", "512", "512", 9, 0, 5), ("sH", "435663", "512", 3, 1, 5), ("sH", "512", "51268", 9, 1, 5), ("sH", "435663", "435663", 12, 0, 4), ("sH", "435663", "51268", 12, 0, 6), ("sH", "51268", "51268", 0, 2, 6),
]
PHASES = ("sI", "sII", "sH")
#: Cages of the first crystal of a frame that share a five-face with the same number of the second.
INTERFACE = 20
ALIEN = "4^6-6^8"
KEPT = 28


def crystal(phase: str) -> tuple[list[tuple[int, str, tuple[int, ...]]], list[tuple[int, int, int]]]:
    """Cages (number, type, place) and faces (number, number, sides) of a periodic block."""
    n, unit, hexagonal = CELLS[phase]
    cages = [(t, tuple(c * u + p for c, u, p in zip(cell, unit, place, strict=True))) for cell in product(range(n), repeat=3) for t, place in SITES[phase]]
    rules = {(a, b, p, q): face for name, a, b, p, q, face in RULES if name == phase}
    faces = []
    for k, (s, a) in enumerate(cages):
        for j, (t, b) in enumerate(cages[:k]):
            x, y, z = ((v - w + n * u // 2) % (n * u) - n * u // 2 for v, w, u in zip(a, b, unit, strict=True))
            plane, axis = (x * x + y * y - x * y, abs(z)) if hexagonal else (x * x + y * y + z * z, 0)
            if face := rules.get((*sorted((s, t)), plane, axis)):
                faces.append((j, k, face))
    return [(k, t, p) for k, (t, p) in enumerate(cages)], faces


def faulty_crystals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cages, rings) with a frame for each nation: one crystal, its phase by the nation's key, and in even nations a second one that touches it.

    A supplier is a fault of a crystal of its nation: a missing cage if its balance is
    positive, else a cage of a type that no phase has. Every fifth nation has about KEPT of
    101 cages left, so that many are alone or in small groups.
    """
    made = {p: crystal(p) for p in PHASES}
    cages = spark.createDataFrame([(n, k, t, len(made[p][0])) for n, p in enumerate(PHASES) for k, t, _ in made[p][0]], "phase int, number int, cage_type string, total int")
    faces = spark.createDataFrame([(n, a, b, s) for n, p in enumerate(PHASES) for a, b, s in made[p][1]], "phase int, one int, two int, size int")
    nation = table(spark, sf_dir, "nation").select(F.lit("A").alias("group_key"), F.col("n_nationkey").cast("int").alias("frame_index"))
    first = nation.select(*K, F.lit(0).alias("part"), (F.col("frame_index") % 3).alias("phase"))
    both = first.unionByName(nation.where("frame_index % 2 = 0").select(*K, F.lit(1).alias("part"), ((F.col("frame_index") + 1) % 3).alias("phase")))
    fault = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("frame_index"), (F.col("s_suppkey") % 2).cast("int").alias("part"), (F.col("s_suppkey") * 37).alias("hit"), (F.col("s_acctbal") > 0).alias("gone"))
    sparse = (F.col("frame_index") % 5 == 4) & ((F.col("number") * F.col("number") * 31 + F.col("number") * 17 + F.col("part") * 7) % 101 >= KEPT)
    placed = both.join(F.broadcast(cages), "phase").where(~sparse)  # three small crystals for each frame
    struck = placed.join(fault, ["frame_index", "part"]).where("number = hit % total").groupBy(*K, "part", "number").agg(F.bool_or("gone").alias("gone"))
    rows = placed.join(struck, [*K, "part", "number"], "left").where("gone IS NULL OR NOT gone")
    rows = rows.select(*K, "part", "number", F.when(F.col("gone").isNull(), F.col("cage_type")).otherwise(ALIEN).alias("cage_type"))
    walls = both.join(F.broadcast(faces), "phase").select(*K, F.format_string("f%d_%d_%d", "part", "one", "two").alias("ring_id"), "size", F.explode(F.array(F.struct("part", F.col("one").alias("number")), F.struct("part", F.col("two").alias("number")))).alias("c"))
    joint = nation.where("frame_index % 2 = 0").withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(INTERFACE - 1))))
    joint = joint.select(*K, F.format_string("x%d", "number").alias("ring_id"), F.lit(5).alias("size"), F.explode(F.array(*[F.struct(F.lit(p).alias("part"), "number") for p in (0, 1)])).alias("c"))
    sides = walls.unionByName(joint).select(*K, "ring_id", "size", "c.part", "c.number")
    node = F.col("part").cast("long") * 1000 + F.col("number")
    rings = sides.select(*K, "ring_id", F.col("size").cast("int").alias("size")).distinct().withColumn("nodes", F.array().cast("array<bigint>"))
    own = sides.groupBy(*K, "part", "number").agg(F.array_sort(F.collect_list("ring_id")).alias("rings"))
    shells = rows.join(own, [*K, "part", "number"]).select(*K, F.format_string("c%04d", node).alias("cage_id"), "cage_type", "rings", F.array(node).alias("waters"))
    return shells, rings
