"""Reports over frames: dashboards, precursors of a track, water histories."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.cages import face_counts, type_name
from latticework.operators.graphs import K, both_ways, components


def dashboard(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, frames, min, mean, max) of columns of a summary, over all frames."""
    pairs = ", ".join(f"'{m}', cast(`{m}` AS double)" for m in metrics)
    rows = summary.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric, value)")
    return rows.groupBy("metric").agg(F.count("value").alias("frames"), F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))


def precursors(seen: DataFrame, track: str, edges: DataFrame, objects: dict[str, DataFrame]) -> DataFrame:
    """(K, bonds, largest, state) of the waters of a track's first cage, in the frames before its birth.

    objects are tables of (K, waters) by kind: cage, quasi, half or ring. The state is the
    highest kind with an object made of the target's waters alone, else connected (all in
    one component) or dispersed.
    """
    own = seen.where(F.col("track") == track)
    born = own.groupBy("group_key").agg(F.min("frame_index").alias("born"), F.min_by("waters", "frame_index").alias("target"))
    frames = edges.select(*K).distinct().join(F.broadcast(born), "group_key").where("frame_index < born")  # one row for each group
    waters = frames.select(*K, F.explode("target").alias("node"))
    near = edges.select(*K, "u", "v").join(waters.withColumnRenamed("node", "u"), [*K, "u"], "left_semi").join(waters.withColumnRenamed("node", "v"), [*K, "v"], "left_semi").select(*K, "u", "v")
    bonds = near.groupBy(*K).agg(F.count("*").alias("bonds"))
    sizes = components(waters, near).groupBy(*K, "component").agg(F.count("*").alias("n")).groupBy(*K).agg(F.max("n").alias("largest"))
    out = frames.select(*K, F.size("target").alias("size"), "target").join(bonds, K, "left").join(sizes, K, "left")
    order = [k for k in ("cage", "quasi", "half", "ring") if k in objects]
    for kind in order:
        inside = objects[kind].join(frames.select(*K, "target"), K).where(F.size(F.array_except("waters", "target")) == 0).select(*K, F.lit(True).alias(f"_{kind}")).distinct()
        out = out.join(inside, K, "left")
    loose = F.when(F.col("largest") == F.col("size"), "connected").otherwise("dispersed")
    state = reduce(lambda c, k: F.when(F.col(f"_{k}"), k).otherwise(c), reversed(order), loose)
    return out.select(*K, F.coalesce("bonds", F.lit(0)).alias("bonds"), F.coalesce("largest", F.lit(0)).alias("largest"), state.alias("state"))


def water_history(seen: DataFrame, track: str, edges: DataFrame, points: DataFrame) -> DataFrame:
    """(K, node, x, y, z, degree) of a track's first waters in all frames; degree counts bonds among them."""
    born = seen.where(F.col("track") == track).groupBy("group_key").agg(F.min_by("waters", "frame_index").alias("target"))
    rows = points.join(F.broadcast(born), "group_key").where(F.array_contains("target", F.col("node"))).select(*K, "node", "x", "y", "z")
    ends = rows.select(*K, "node")
    inner = both_ways(edges).join(ends.withColumnRenamed("node", "a"), [*K, "a"], "left_semi").join(ends.withColumnRenamed("node", "b"), [*K, "b"], "left_semi")
    degree = inner.groupBy(*K, F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    return rows.join(degree, [*K, "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


# What a phase or a status may be called.
PHASE_NAMES = {"i": "sI", "si": "sI", "ii": "sII", "sii": "sII", "h": "sH", "sh": "sH"} | {n: n for n in ("boundary", "unclassified", "ambiguous", "isolated", "unassigned", "mixed")}


def parse_targets(text: str) -> list[tuple[str, str]]:
    """(kind, value) of a comma-separated list: all, a track such as t12, a phase or status, or a cage type."""
    out = []
    for part in (p.strip() for p in text.split(",")):
        if not part:
            continue
        if part.casefold() == "all":
            found = "all", "all"
        elif re.fullmatch(r"[tT]\d+", part):
            found = "track", f"t{int(part[1:])}"
        elif part.casefold() in PHASE_NAMES:
            found = "phase", PHASE_NAMES[part.casefold()]
        else:
            found = "cage_type", type_name(*face_counts(part))
        if found not in out:
            out.append(found)
    if not out:
        raise ValueError("no target")
    return out


def select_targets(seen: DataFrame, target: str) -> DataFrame:
    """The whole lives of tracks that match once any target of a list."""
    hit = F.lit(False)
    for kind, value in parse_targets(target):
        if kind == "all":
            return seen
        if kind == "phase":
            hit |= F.array_contains("phases", value) if "phases" in seen.columns else F.lit(False)
        else:
            hit |= F.col(kind) == value
    return seen.join(seen.where(hit).select("group_key", "track").distinct(), ["group_key", "track"], "left_semi")


def target_events(events: DataFrame, kept: DataFrame) -> DataFrame:
    """Events(group_key, ..., source, destination) that touch a track of kept."""
    own = kept.select("group_key", "track").distinct()
    key = ["group_key", "frame_index", "kind", "source", "destination"]
    touched = events.select(*key, F.explode(F.split(F.concat_ws(" ", "source", "destination"), " ")).alias("track")).join(own, ["group_key", "track"], "left_semi")
    return events.join(touched.select(*key).distinct(), key, "left_semi")
