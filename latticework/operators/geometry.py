"""Shape of ring faces and cages: planarity, edge variation, area, volume."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.pbc import cross, delta, dot, vec
from latticework.operators.cages import _triangles, cage_centers
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K
from latticework.operators.rings import ring_nodes

FACES = "group_key string, frame_index int, ring_id string, planarity double, edge_cv double, area double, nx double, ny double, nz double"


def ring_geometry(rings: DataFrame, points: DataFrame) -> DataFrame:
    """FACES: best-plane deviation, variation of side lengths, area projected on the plane, and its normal.

    The normal is the least singular direction of the corners; rings are handled in
    batches of equal size.
    """
    walk = Window.partitionBy(*K, "ring_id").orderBy("place")
    rows = ring_nodes(rings).join(points, [*K, "node"])
    rows = rows.select("*", *[F.lag(c).over(walk).alias(f"b{c}") for c in "xyz"])
    step = delta(vec("b"), vec(""), vec("l"))
    rows = rows.select(*K, "ring_id", "size", "place", *[F.coalesce(s, F.lit(0.0)).alias(f"s{c}") for c, s in zip("xyz", step, strict=True)])
    upto = walk.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*K, "ring_id", "size", "place", *[F.sum(f"s{c}").over(upto).alias(c) for c in "xyz"])
    flat = rows.groupBy(*K, "ring_id", "size").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y", "z"))).alias("p"))
    flat = flat.select(*K, "ring_id", "size", F.flatten(F.transform("p", lambda c: F.array(c["x"], c["y"], c["z"]))).alias("corners"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            corners = batch.column("corners")
            out = np.zeros((batch.num_rows, 6))
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                c = np.array(corners.take(pa.array(own)).flatten()).reshape(len(own), n, 3)
                middle = c - c.mean(axis=1, keepdims=True)
                normal = np.linalg.svd(middle, full_matrices=False)[2][:, -1]
                after = np.roll(middle, -1, axis=1)
                sides = np.linalg.norm(after - middle, axis=2)
                out[own, 0] = np.sqrt((np.einsum("rnk,rk->rn", middle, normal) ** 2).mean(axis=1))
                out[own, 1] = sides.std(axis=1) / np.maximum(sides.mean(axis=1), 1e-300)
                out[own, 2] = 0.5 * np.abs(np.einsum("rk,rk->r", np.cross(middle, after).sum(axis=1), normal))
                out[own, 3:] = normal
            keys = [batch.column(name) for name in (*K, "ring_id")]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(out[:, k]) for k in range(6)]], names=[f.split()[0] for f in FACES.split(", ")])

    return flat.mapInArrow(measure, FACES)


def cage_volumes(cages: DataFrame, rings: DataFrame, points: DataFrame) -> DataFrame:
    """(K, cage_id, volume, cx, cy, cz): volume of the triangulated faces, and its centroid."""
    centers = checkpoint(cage_centers(cages, points))
    parts = _triangles(cages, rings, points, centers)
    p, q, r = vec("p"), vec("q"), vec("r")
    piece = dot(p, cross(q, r)) / 6
    mean = [((a + b + c) / 4 * piece).alias(f"w{n}") for n, a, b, c in zip("xyz", p, q, r, strict=True)]
    sums = parts.select(*K, "cage_id", piece.alias("v"), *mean).groupBy(*K, "cage_id").agg(F.sum("v").alias("v"), *[F.sum(f"w{c}").alias(f"w{c}") for c in "xyz"])
    out = sums.where(F.abs("v") > 1e-12).join(centers.select(*K, "cage_id", "cx", "cy", "cz"), [*K, "cage_id"])
    return out.select(*K, "cage_id", F.abs("v").alias("volume"), *[(F.col(f"c{c}") + F.col(f"w{c}") / F.col("v")).alias(f"c{c}") for c in "xyz"])


def sound_cages(cages: DataFrame, rings: DataFrame, points: DataFrame, planarity: float = 0.06, edge_cv: float = 0.35, area: float = 1e-12, volume: float = 1e-6) -> DataFrame:
    """Cages whose faces are flat and even enough and whose volume is large enough."""
    faces = cages.select(*K, "cage_id", F.explode("rings").alias("ring_id")).join(ring_geometry(rings, points), [*K, "ring_id"], "left")
    flat = (F.col("planarity") <= planarity) & (F.col("edge_cv") <= edge_cv) & (F.col("area") > area)
    good = faces.groupBy(*K, "cage_id").agg(F.bool_and(F.coalesce(flat, F.lit(False))).alias("ok")).where("ok").drop("ok")
    large = cage_volumes(cages, rings, points).where(F.col("volume") >= volume).select(*K, "cage_id")
    return cages.join(good, [*K, "cage_id"], "left_semi").join(large, [*K, "cage_id"], "left_semi")
