"""Frames of molecules made from the driver's tables, so that every operator has typed input."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.graphs import K

#: Cutoff of the point frames at 500 points; denser frames get a shorter one.
CUTOFF, POINTS = 0.12, 500
#: Edge of the placed polyhedra and spacing of their sites, in nm.
EDGE, SPACING = 0.28, 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points of a unit periodic box, one frame a label, with two O-H vectors each."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda i: F.get("embedding", F.lit(i)).cast("double")

    def unit(i: int) -> Column:
        size = F.sqrt(part(i) * part(i) + part(i + 1) * part(i + 1) + part(i + 2) * part(i + 2))
        return F.struct(*[(part(i + k) / size * 0.1).alias(c) for k, c in enumerate("xyz")])

    return e.select(
        F.lit("A").alias("group_key"), F.col("label").cast("int").alias("frame_index"), F.col("vec_id").alias("node"),
        *[(part(k) + 0.5).alias(c) for k, c in enumerate("xyz")], *[F.lit(1.0).alias(f"l{c}") for c in "xyz"], F.array(unit(3), unit(6)).alias("hydrogens"),
    )


def cutoff(spark: SparkSession, sf_dir: str) -> float:
    n = table(spark, sf_dir, "embeddings").count()
    return CUTOFF * math.pow(min(1.0, POINTS / max(1, n)), 1 / 3)


def frames(nodes: DataFrame) -> DataFrame:
    return nodes.select(*K).distinct()


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as atoms: a residue an order, the flag as atom name, one frame."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey", "left")
    return rows.select(
        F.lit("A").alias("group_key"), F.lit(0).alias("frame_index"), F.struct(*order).alias("atom"), F.col("l_orderkey").alias("resid"),
        F.coalesce("o_orderpriority", F.lit("NONE")).alias("resname"), F.col("l_returnflag").alias("atomname"),
    )


def shapes() -> list[tuple[int, str, list[tuple[float, float, float]]]]:
    """Corners, of unit edge about the origin, of cube, hexagonal prism, dodecahedron and truncated octahedron."""
    golden = (1 + math.sqrt(5)) / 2
    cube = [(x / 2, y / 2, z / 2) for x, y, z in product((-1, 1), repeat=3)]
    prism = [(math.cos(k * math.pi / 3), math.sin(k * math.pi / 3), z / 2) for z in (-1, 1) for k in range(6)]
    twelve = [*product((-1, 1), repeat=3)]
    for a, b in product((-1, 1), repeat=2):
        twelve += [(0, a / golden, b * golden), (a / golden, b * golden, 0), (a * golden, 0, b / golden)]
    side = 2 / golden
    dodecahedron = [(x / side, y / side, z / side) for x, y, z in twelve]
    rim = sorted({p for a, b in product((-1, 1), (-2, 2)) for p in ((0, a, b), (0, b, a), (a, 0, b), (b, 0, a), (a, b, 0), (b, a, 0))})
    octahedron = [(x / math.sqrt(2), y / math.sqrt(2), z / math.sqrt(2)) for x, y, z in rim]
    return [(0, "4^6", cube), (1, "4^6-6^2", prism), (2, "512", dodecahedron), (3, "4^6-6^8", octahedron)]


def polyhedra(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(waters, guests): a polyhedron of waters for each supplier, its nation being the frame.

    Sites are SPACING apart in a row; suppliers with a positive balance have a guest at
    the centre, those above 5000 two guests.
    """
    corners = spark.createDataFrame([(s, k, *map(float, c)) for s, _, cs in shapes() for k, c in enumerate(cs)], "shape int, corner int, cx double, cy double, cz double")
    site = table(spark, sf_dir, "supplier").select(
        F.lit("A").alias("group_key"), F.col("s_nationkey").cast("int").alias("frame_index"), F.col("s_suppkey").cast("long").alias("site"), (F.col("s_suppkey") % 4).cast("int").alias("shape"), F.col("s_acctbal").alias("balance")
    )
    none = [F.lit(None).cast("double").alias(f"l{c}") for c in "xyz"]
    waters = site.join(F.broadcast(corners), "shape").select(*K, (F.col("site") * 64 + F.col("corner")).alias("node"), (F.col("site") * SPACING + F.col("cx") * EDGE).alias("x"), (F.col("cy") * EDGE).alias("y"), (F.col("cz") * EDGE).alias("z"), *none)
    count = F.when(F.col("balance") > 5000, F.array(F.lit(0), F.lit(1))).when(F.col("balance") > 0, F.array(F.lit(0))).otherwise(F.array())
    guests = site.withColumn("k", F.explode(count.cast("array<int>"))).select(*K, (F.col("site") * 64 + 32 + F.col("k")).alias("node"), (F.col("site") * SPACING + F.col("k") * 0.01).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), *none, F.lit("CH4").alias("resname"))
    return waters, guests


def snapshots(spark: SparkSession, sf_dir: str, hours: int = 12, window: int = 2) -> DataFrame:
    """(K, time_ps, cage_id, cage_type, waters): users of each event type in the last window steps, a step being so many hours."""
    step = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / (hours * 3600)).cast("int")
    seen = table(spark, sf_dir, "events").select(step.alias("step"), "event_type", "user_id").where("step >= 0").distinct()
    last = seen.agg(F.max("step").alias("last"))
    spread = seen.join(F.broadcast(last)).withColumn("frame_index", F.explode(F.sequence("step", F.least(F.col("step") + window - 1, F.col("last")))))
    return (
        spread.groupBy("frame_index", "event_type").agg(F.array_sort(F.collect_set("user_id")).alias("waters"))
        .select(F.lit("A").alias("group_key"), "frame_index", (F.col("frame_index") * float(hours)).alias("time_ps"), F.col("event_type").alias("cage_id"), F.col("event_type").alias("cage_type"), "waters")
    )
