"""Queries over placed polyhedra, whose answers follow from the supplier table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import cages, geometry, neighbors, patches, phases, reports, rings
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K
from latticework.sources.adapters import polyhedra
from latticework.sources.files import membership


def _rings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    waters, guests = polyhedra(spark, sf_dir)
    return waters, guests, checkpoint(rings.find_rings(checkpoint(neighbors.oo_edges(waters))))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    waters, guests, found = _rings(spark, sf_dir)
    return waters, guests, found, checkpoint(cages.find_cages(found))


def cage_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, found = _found(spark, sf_dir)
    site = F.floor(F.get("waters", F.lit(0)) / 64).cast("long")
    return found.select("frame_index", site.alias("site"), "cage_type", F.size("rings").alias("faces"), F.size("waters").alias("waters"))


def cage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, found = _found(spark, sf_dir)
    kinds = ["4^6", "4^6-6^2", "512", "4^6-6^8"]
    wide = found.groupBy("frame_index").pivot("cage_type", kinds).count()
    return wide.select("frame_index", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"cages_{i}") for i, k in enumerate(kinds)])


def cage_isomers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, found, shells = _found(spark, sf_dir)
    return cages.isomers(shells, found).groupBy("frame_index", "cage_type", "isomer").agg(F.count("*").alias("cages"))


def cage_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    waters, _, _, shells = _found(spark, sf_dir)
    made = cages.cage_centers(shells, waters)
    return made.select("frame_index", F.round("cx", 6).alias("cx"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("cy", "cz")])


def cage_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets over type, occupancy and composition."""
    waters, guests, found, shells = _found(spark, sf_dir)
    rows = cages.compositions(shells, cages.occupancy(shells, found, waters, guests), guests)
    rows.createOrReplaceTempView("latticework_compositions")
    return spark.sql("SELECT frame_index, cage_type, occupancy, composition, count(*) AS cages FROM latticework_compositions GROUP BY GROUPING SETS ((frame_index), (frame_index, occupancy), (frame_index, cage_type, occupancy, composition))")


def cage_occupancy_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    waters, guests, found, shells = _found(spark, sf_dir)
    held = cages.occupancy(shells, found, waters, guests, mode="center", radius=0.3)
    return held.groupBy("frame_index").agg(F.count("*").alias("held"), F.countDistinct("cage_id").alias("occupied"))


def cage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, shells = _found(spark, sf_dir)
    return cages.clusters(shells).groupBy("frame_index", "size").agg(F.count("*").alias("cages"))


def ring_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings and free rings by size."""
    _, _, found, shells = _found(spark, sf_dir)
    used = shells.select(*K, F.explode("rings").alias("ring_id")).distinct()
    free = rings.free_rings(found, used).select(*K, "ring_id", F.lit(1).alias("free"))
    rows = found.join(free, [*K, "ring_id"], "left")
    return rows.groupBy("frame_index").agg(*[F.count_if(F.col("size") == n).alias(f"rings_{n}") for n in (4, 5, 6)], *[F.count_if((F.col("size") == n) & (F.col("free") == 1)).alias(f"free_{n}") for n in (4, 5, 6)])


def frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row for each frame."""
    waters, guests, found, shells = _found(spark, sf_dir)
    held = cages.compositions(shells, cages.occupancy(shells, found, waters, guests), guests)
    count = lambda df, name: df.groupBy("frame_index").agg(F.count("*").alias(name))
    out = count(waters, "waters").join(count(guests, "guests"), "frame_index", "left").join(count(neighbors.oo_edges(waters), "edges"), "frame_index", "left").join(count(found, "rings"), "frame_index", "left")
    by = held.groupBy("frame_index").agg(F.count("*").alias("cages"), *[F.count_if(F.col("occupancy") == k).alias(k) for k in ("empty", "single", "multi")])
    return out.join(by, "frame_index", "left").na.fill(0)


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, mean and largest of the summary's metrics."""
    made = reports.dashboard(frame_summary(spark, sf_dir), ["waters", "guests", "edges", "rings", "cages", "empty"])
    return made.select("metric", "frames", "min", F.round("mean", 6).alias("mean"), "max")


def half_cages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open patches by type; every face of a dodecahedron is the base of one."""
    waters, _, found, shells = _found(spark, sf_dir)
    none = [F.lit(None).cast("double").alias(f"l{c}") for c in "xyz"]
    open_ = checkpoint(patches.find_patches(found, rings.ring_centers(found, waters).select("*", *none)))
    free = patches.free_patches(open_, shells).select(*K, "patch_id", F.lit(1).alias("free"))
    return open_.join(free, [*K, "patch_id"], "left").groupBy("frame_index", "kind", "patch_type").agg(F.count("*").alias("patches"), F.count("free").alias("free"))


def ring_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and flatness of four- and five-faces."""
    waters, _, found, _ = _found(spark, sf_dir)
    faces = geometry.ring_geometry(found, waters).join(found.where("size < 6"), [*K, "ring_id"])
    return faces.groupBy("frame_index", "size").agg(F.count("*").alias("faces"), F.round(F.sum("area"), 6).alias("area"), F.round(F.max("edge_cv"), 6).alias("uneven"), F.round(F.max("planarity"), 6).alias("bent"))


def cage_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    waters, _, found, shells = _found(spark, sf_dir)
    sound = checkpoint(geometry.sound_cages(shells, found, waters))  # read several times
    made = geometry.cage_volumes(sound, found, waters).join(sound, [*K, "cage_id"])
    return made.groupBy("frame_index", "cage_type").agg(F.count("*").alias("cages"), F.round(F.sum("volume"), 6).alias("volume"))


def phase_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single cages belong to no phase."""
    _, _, found, shells = _found(spark, sf_dir)
    return phases.phase_domains(shells, found).groupBy("frame_index", "status").agg(F.count("*").alias("cages"), F.countDistinct("domain").alias("domains"))


def membership_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    waters, guests, found, shells = _found(spark, sf_dir)
    rows = membership(found, shells, cages.occupancy(shells, found, waters, guests))
    return rows.groupBy("frame_index", "record").agg(F.count("*").alias("members"), F.countDistinct("object_id").alias("objects"))


FIXED = (cage_list, cage_table, cage_isomers, cage_centers, cage_occupancy, cage_occupancy_center, cage_clusters, ring_table, frame_summary, dashboard, half_cages, ring_areas, cage_volumes, phase_status, membership_counts)

_SITES = """WITH shapes(shape, cage_type, faces, waters, edges, rings4, rings5, rings6, free6, isomer) AS (VALUES
  (0, '4^6', 6, 8, 12, 6, 0, 4, 4, NULL), (1, '4^6-6^2', 8, 12, 18, 6, 0, 2, 0, '2x6sep'), (2, '512', 12, 20, 30, 0, 12, 0, 0, NULL), (3, '4^6-6^8', 14, 24, 36, 6, 0, 8, 0, '6n8e12d33333333')),
sites AS (SELECT s_nationkey AS frame_index, s_suppkey AS site, CASE WHEN s_acctbal > 5000 THEN 2 WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS guests, s.* FROM supplier JOIN shapes s ON s.shape = s_suppkey % 4),
held AS (SELECT *, CASE guests WHEN 0 THEN 'empty' WHEN 1 THEN 'single' ELSE 'multi' END AS occupancy, CASE guests WHEN 0 THEN 'empty' WHEN 1 THEN 'CH4' ELSE 'CH4x2' END AS composition FROM sites) """
_FRAME = " FROM held GROUP BY frame_index"
SQL = {
    "cage_list": _SITES + "SELECT frame_index, site, cage_type, faces, waters FROM sites",
    "cage_table": _SITES + "SELECT frame_index, " + ", ".join(f"count(*) FILTER (cage_type = '{k}') AS cages_{i}" for i, k in enumerate(["4^6", "4^6-6^2", "512", "4^6-6^8"])) + _FRAME,
    "cage_isomers": _SITES + "SELECT frame_index, cage_type, isomer, count(*) AS cages FROM sites GROUP BY ALL",
    "cage_centers": _SITES + "SELECT frame_index, round(site * 3.0::DOUBLE, 6) AS cx, 0.0::DOUBLE AS cy, 0.0::DOUBLE AS cz FROM sites",
    "cage_occupancy": _SITES + "SELECT frame_index, cage_type, occupancy, composition, count(*) AS cages FROM held GROUP BY GROUPING SETS ((frame_index), (frame_index, occupancy), (frame_index, cage_type, occupancy, composition))",
    "cage_occupancy_center": _SITES + "SELECT frame_index, sum(guests)::BIGINT AS held, count(*) AS occupied FROM sites WHERE guests > 0 GROUP BY frame_index",
    "cage_clusters": _SITES + "SELECT frame_index, 1::BIGINT AS size, count(*) AS cages" + _FRAME,
    "ring_table": _SITES + "SELECT frame_index, " + ", ".join(f"sum(rings{n})::BIGINT AS rings_{n}" for n in (4, 5, 6)) + ", 0::BIGINT AS free_4, 0::BIGINT AS free_5, sum(free6)::BIGINT AS free_6" + _FRAME,
    "frame_summary": _SITES + "SELECT frame_index, sum(waters)::BIGINT AS waters, sum(guests)::BIGINT AS guests, sum(edges)::BIGINT AS edges, sum(rings4 + rings5 + rings6)::BIGINT AS rings, count(*) AS cages, " + ", ".join(f"count(*) FILTER (occupancy = '{k}') AS {k}" for k in ("empty", "single", "multi")) + _FRAME,
}
SQL["dashboard"] = f"WITH summary AS ({SQL['frame_summary']}) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS frames, min({m})::DOUBLE AS min, round(avg({m}), 6) AS mean, max({m})::DOUBLE AS max FROM summary" for m in ("waters", "guests", "edges", "rings", "cages", "empty"))
SQL |= {
    "half_cages": _SITES + "SELECT frame_index, 'half' AS kind, 'hc_5r_5⁵' AS patch_type, 12 * count(*) AS patches, 0::BIGINT AS free FROM sites WHERE cage_type = '512' GROUP BY frame_index",
    "ring_areas": _SITES + """SELECT frame_index, size, n AS faces, round(n * unit * 0.28 * 0.28, 6)::DOUBLE AS area, 0.0::DOUBLE AS uneven, 0.0::DOUBLE AS bent FROM (
  SELECT frame_index, 4 AS size, sum(rings4)::BIGINT AS n, 1.0::DOUBLE AS unit FROM sites GROUP BY frame_index UNION ALL SELECT frame_index, 5, sum(rings5)::BIGINT, sqrt(25 + 10 * sqrt(5)) / 4 FROM sites GROUP BY frame_index) WHERE n > 0""",
    "cage_volumes": _SITES + "SELECT frame_index, cage_type, count(*) AS cages, round(count(*) * pow(0.28, 3) * any_value(CASE shape WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 * sqrt(3) WHEN 2 THEN (15 + 7 * sqrt(5)) / 4 ELSE 8 * sqrt(2) END), 6) AS volume FROM sites GROUP BY frame_index, cage_type",
    "phase_status": _SITES + "SELECT frame_index, 'unclassified' AS status, count(*) AS cages, 0::BIGINT AS domains" + _FRAME,
    "membership_counts": _SITES + """SELECT frame_index, 'R' AS record, sum(4 * rings4 + 5 * rings5 + 6 * rings6)::BIGINT AS members, sum(rings4 + rings5 + rings6)::BIGINT AS objects FROM sites GROUP BY frame_index
UNION ALL SELECT frame_index, 'M', sum(waters)::BIGINT, count(*) FROM sites GROUP BY frame_index UNION ALL SELECT frame_index, 'G', sum(guests)::BIGINT, count(*) FROM sites WHERE guests > 0 GROUP BY frame_index""",
}
