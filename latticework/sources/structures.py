"""Objects of an analysis as atoms, so that they can be written as GRO frames beside the waters they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.graphs import K

CENTER = "CNT"


def _atoms(rows: DataFrame, frames: DataFrame, name: Column, order: list[str], resname: str) -> DataFrame:
    """Atoms of rows(K, x, y, z, ...), one each, in an order; frames are (K, frame, time_ps, source, lx, ly, lz)."""
    if not (resname.isascii() and 1 <= len(resname) <= 5):
        raise ValueError("a residue name has one to five ASCII characters")
    number = F.row_number().over(Window.partitionBy(*K).orderBy(*order))
    return rows.join(frames, K).select(
        *K, "frame", "source", "time_ps", (number - 1).alias("atom"), number.alias("resid"), F.lit(resname).alias("resname"), F.substring(name, 1, 5).alias("atomname"), number.alias("atomid"),
        "x", "y", "z", *[F.lit(None).cast("double").alias(f"v{c}") for c in "xyz"], "lx", "ly", "lz",
    )


def frame_heads(atoms: DataFrame) -> DataFrame:
    """(K, frame, time_ps, source, lx, ly, lz) of each frame of atoms."""
    return atoms.groupBy(*K).agg(*[F.first(c).alias(c) for c in ("frame", "time_ps", "source", "lx", "ly", "lz")])


def _middle(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[F.col(f"c{c}").alias(c) for c in "xyz"]).drop("lx", "ly", "lz")


def ring_atoms(centers: DataFrame, frames: DataFrame, resname: str = CENTER) -> DataFrame:
    """An atom R4 to R7 at the centre of each ring."""
    return _atoms(_middle(centers), frames, F.concat(F.lit("R"), F.col("size").cast("string")), ["size", "ring_id"], resname)


def patch_atoms(patches: DataFrame, ring_centers: DataFrame, frames: DataFrame, resname: str = CENTER) -> DataFrame:
    """An atom HC or QC for each patch, at the mean of its rings' centres near the first one."""
    from latticework.functions.pbc import delta, vec

    own = patches.select(*K, "patch_id", "kind", F.element_at("rings", 1).alias("first"), F.explode("rings").alias("ring_id"))
    box = frames.select(*K, "lx", "ly", "lz")
    place = lambda n, p: ring_centers.select(*K, F.col("ring_id").alias(n), *[F.col(f"c{c}").alias(f"{p}{c}") for c in "xyz"])
    rows = own.join(place("first", "a"), [*K, "first"]).join(place("ring_id", "b"), [*K, "ring_id"]).join(box, K)
    near = delta(vec("a"), vec("b"), vec("l"))
    mean = rows.groupBy(*K, "patch_id", "kind").agg(*[F.avg(F.col(f"a{c}") + d).alias(c) for c, d in zip("xyz", near, strict=True)])
    return _atoms(mean, frames, F.when(F.col("kind") == "half", "HC").otherwise("QC"), ["kind", "patch_id"], resname)


def cage_atoms(centers: DataFrame, kinds: DataFrame, frames: DataFrame, cage_type: str | None = None, occupied: bool | None = None, resname: str = CENTER) -> DataFrame:
    """An atom named after its type at the centre of each cage, of one type or all, empty or occupied ones or all."""
    rows = _middle(centers).join(kinds.select(*K, "cage_id", "cage_type", "occupancy"), [*K, "cage_id"])
    if cage_type is not None:
        rows = rows.where(F.col("cage_type") == cage_type)
    if occupied is not None:
        rows = rows.where((F.col("occupancy") != "empty") == F.lit(occupied))
    return _atoms(rows, frames, F.regexp_replace("cage_type", "[^0-9]", ""), ["cage_type", "cage_id"], resname)


def cluster_atoms(centers: DataFrame, clusters: DataFrame, frames: DataFrame, resname: str = CENTER, min_cage: int = 2) -> DataFrame:
    """Centres of the cages of clusters, atoms named by the cluster's place among those of its frame."""
    place = F.dense_rank().over(Window.partitionBy(*K).orderBy("cluster"))
    rows = _middle(centers).join(clusters.where(F.col("size") >= min_cage), [*K, "cage_id"]).withColumn("place", place)
    return _atoms(rows, frames, F.concat(F.lit("C"), F.col("place").cast("string")), ["place", "cage_id"], resname)


def ice_atoms(points: DataFrame, ice: DataFrame, frames: DataFrame, resname: str = "ICE") -> DataFrame:
    """Waters of ice, ICEI or INTF."""
    rows = points.select(*K, "node", "x", "y", "z").join(ice.where("ice <> 'liquid'"), [*K, "node"])
    return _atoms(rows, frames, F.when(F.col("ice") == "ice_i", "ICEI").otherwise("INTF"), ["node"], resname)


def annotated(atoms: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Atoms whose vx is a value of their water's (K, node, column), 0 where it has none: values shown in place of velocities."""
    joined = atoms.join(values.select(*K, F.col("node").alias("atom"), F.col(column).alias("_v")), [*K, "atom"], "left")
    return joined.select(*[F.coalesce("_v", F.lit(0.0)).alias(c) if c == "vx" else F.lit(0.0).alias(c) if c in ("vy", "vz") else F.col(c) for c in atoms.columns])
