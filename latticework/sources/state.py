"""Tracking results on disk: a state that can be read again, and its six tables as CSV.

A state is a folder of JSON lines, one part for each of frames, tracks (observations) and
events, and the configuration, so that it may be larger than any machine's memory.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import tracking
from latticework.operators.graphs import K
from latticework.sources.files import write_tables

FORMAT, VERSION = "latticework-tracks", 1
FRAMES = "group_key string, frame_index int, time_ps double"
TRACKS = "group_key string, frame_index int, time_ps double, track string, rank int, cage_id string, cage_type string, waters array<bigint>, " + ", ".join(f"{n} {t}" for n, t in tracking.OPTIONAL.items()) + ", jaccard double, fraction double, distance double, topology_similarity double, gap int"
EVENTS = "group_key string, frame_index int, event_id string, kind string, source string, destination string, censored boolean"


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    kinds = [c.split(" ", 1) for c in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds])


def write_state(folder: str, seen: DataFrame, events: DataFrame, frames: DataFrame, config: tracking.TrackingConfig) -> None:
    """A new folder with the state; an existing one is an error."""
    spark = seen.sparkSession
    head = spark.createDataFrame([(FORMAT, VERSION, json.dumps(asdict(config)))], "format string, version int, config string")
    for name, df in (("state", head), ("frames", _shaped(frames, FRAMES)), ("tracks", _shaped(seen, TRACKS)), ("events", _shaped(events, EVENTS))):
        df.write.mode("errorifexists").json(f"{folder}/{name}")


def read_state(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, tracking.TrackingConfig]:
    """(observations, events, frames, config) of a state; one that does not hold together is an error."""
    head = spark.read.schema("format string, version int, config string").json(f"{folder}/state").first()
    if head is None or head["format"] != FORMAT:
        raise ValueError("not a tracking state")
    if head["version"] != VERSION:
        raise ValueError(f"a tracking state of version {head['version']} is not known")
    frames, seen, events = (spark.read.schema(s).json(f"{folder}/{n}") for n, s in (("frames", FRAMES), ("tracks", TRACKS), ("events", EVENTS)))
    for fault, why in faults(seen, events, frames).items():
        if bad := fault.first():
            raise ValueError(f"the state does not hold together: {why}, such as {bad.asDict()}")
    return seen, events, frames, tracking.TrackingConfig(**json.loads(head["config"]))


def faults(seen: DataFrame, events: DataFrame, frames: DataFrame) -> dict[DataFrame, str]:
    """Rows that contradict others, by what is wrong with them."""
    own = seen.select("group_key", "track").distinct()
    named = events.select("group_key", "event_id", F.explode(F.split(F.concat_ws(" ", "source", "destination"), " ")).alias("track")).where("track <> ''")
    return {
        tracking.check_order(frames): "frames are not consecutive or go back in time",
        seen.select(*K).distinct().join(frames.select(*K), K, "left_anti"): "a cage is in no frame",
        seen.groupBy(*K, "track").count().where("count > 1"): "a track is twice in a frame",
        seen.where(~F.col("track").rlike("^t[1-9][0-9]*$")).select("track"): "a track has no number",
        named.join(own, ["group_key", "track"], "left_anti"): "an event names a track that is not there",
        events.groupBy("group_key", "event_id").count().where("count > 1"): "an event number repeats",
    }


def track_tables(seen: DataFrame, events: DataFrame, frames: DataFrame, guests: DataFrame | None = None, gap_frame: int = 0) -> dict[str, DataFrame]:
    """The six tables of a tracking result: observations, lifetimes, their distribution, population, events, residences of guests."""
    lives = tracking.lifetimes(seen, frames, gap_frame)
    if guests is None:
        if "guests" not in seen.columns:
            seen = seen.withColumn("guests", F.array().cast("array<string>"))
        guests = seen.select(*K, "cage_id", F.explode("guests").alias("guest"))
    return {
        "observations": seen, "lifetimes": tracking.track_table(seen, frames, gap_frame), "lifetime_distribution": tracking.lifetime_distribution(lives),
        "population": tracking.population(seen, frames), "events": events, "guest_residence": tracking.guest_residence(seen, guests, lives),
    }


def write_track_tables(folder: str, tables: dict[str, DataFrame]) -> None:
    write_tables(tables, folder, "csv")
