"""Round trips: frames and results are written to the shared folder and read again. With their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import rings, select, tracking
from latticework.operators import tables as report
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K, joined
from latticework.sources import files, state
from latticework.sources.adapters import points, snapshots, table
from latticework.streaming.tracks import track_stream


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder of checkpoints."""
    checkpoint(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point frames as atoms of single-atom waters."""
    number = F.row_number().over(rings.Window.partitionBy(*K).orderBy("node"))
    rows = points(spark, sf_dir).withColumn("k", number)
    return rows.select(
        *K, F.format_string("label %d", "frame_index").alias("frame"), (F.col("frame_index") * 2.5).alias("time_ps"), (F.col("k") - 1).alias("atom"), "k", F.col("k").alias("resid"), F.lit("SOL").alias("resname"), F.lit("OW").alias("atomname"), F.col("k").alias("atomid"), "x", "y", "z", "lx", "ly", "lz"
    )


def _sums(atoms: DataFrame) -> DataFrame:
    """What a frame's atoms add up to, so that a lost, doubled or misread one shows."""
    place = [F.round(F.sum(F.col(c) * F.col("atomid")), 4).alias(f"sum_{c}") for c in "xyz"]
    return atoms.groupBy("frame_index").agg(F.count("*").alias("atoms"), F.min("time_ps").alias("time_ps"), F.round(F.max("lx"), 6).alias("box"), *place)


def gro_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GRO file for each frame; times come from titles."""
    folder = scratch(spark)
    files.write_gro(_atoms(spark, sf_dir), folder)
    read = files.read_frames(spark, folder, recursive=True, form="gro")
    return _sums(read).withColumn("box", F.round("box", 3))


def gro_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames in one file, each of as many atoms as the smallest frame has."""
    atoms = _atoms(spark, sf_dir)
    least = atoms.groupBy("frame_index").count().agg(F.min("count").alias("least"))
    folder = scratch(spark)
    files.write_lines(files.gro_lines(atoms.join(F.broadcast(least)).where("k <= least")), folder, stacked=True)  # one row
    return _sums(files.read_frames(spark, folder, recursive=True, form="gro")).withColumn("box", F.round("box", 3))


def dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text dump of all frames in nm and ns."""
    folder = scratch(spark)
    files.write_lines(files.dump_lines(_atoms(spark, sf_dir), 1.0), folder, stacked=True)
    return _sums(files.read_frames(spark, folder, recursive=True, form="dump", units="nano"))


def xyz_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One XYZ file for each frame; there are no times and no boxes in it."""
    folder = scratch(spark)
    files.write_lines(files.xyz_lines(_atoms(spark, sf_dir)), folder)
    return _sums(files.read_frames(spark, folder, recursive=True, form="xyz")).drop("time_ps", "box")


def frame_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(files.frame_slice(_atoms(spark, sf_dir), [7, 2, 2, 5])).select("frame_index", "atoms")


def pair_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written with three separators and comments, read, and resolved by residue number."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_suppkey").cast("string").alias("a"), (F.col("l_partkey") % 50).cast("string").alias("b"))
    sep = F.element_at(F.array(F.lit(" "), F.lit(", "), F.lit(" ; ")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    folder = scratch(spark)
    rows.select(F.concat("a", sep, "b", F.lit("  # a pair")).alias("value")).write.text(folder)
    key = [F.lit("A").alias("group_key"), F.lit(0).alias("frame_index")]
    found = checkpoint(files.read_pairs(spark, folder).distinct())  # read several times
    waters = found.select(F.explode(F.array("u", "v")).alias("resid")).distinct().select(*key, "resid", (F.col("resid") * 3).alias("oxygen"))
    atoms = waters.select(*K, F.col("oxygen").alias("atom"), F.col("resid").alias("atomid"))
    return select.pair_nodes(found.select(*key, "u", "v"), waters, atoms, "resid").select("u", "v")


def topology_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as frames whose suppliers are single atoms: frames of as many atoms have one topology."""
    rows = table(spark, sf_dir, "supplier").select(F.lit("A").alias("group_key"), F.col("s_nationkey").cast("int").alias("frame_index"), F.col("s_suppkey").alias("atom"), F.col("s_suppkey").alias("resid"), F.lit("SOL").alias("resname"), F.lit("OW").alias("atomname"))
    found = checkpoint(select.topology_letters(select.topology(select.residues(rows))))
    return found.select("frame_index", "atoms", "letter")


def track_state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a tracking state that was written and read, which checks that it holds together."""
    snaps = snapshots(spark, sf_dir)
    frames = checkpoint(tracking.frame_table(snaps))
    config = tracking.TrackingConfig()
    seen, candidates = tracking.track(snaps, config, frames)
    folder = scratch(spark)
    state.write_state(folder, seen, tracking.event_table(seen, candidates, frames), frames, config)
    again, events, _, _ = state.read_state(spark, folder)
    count = events.groupBy("frame_index").agg(F.count("*").alias("events"))
    return again.groupBy("frame_index").agg(F.count("*").alias("cages"), joined(F.array_sort(F.collect_list(F.substring("track", 2, 9).cast("long")))).alias("tracks")).join(count, "frame_index", "left").withColumn("events", F.coalesce("events", F.lit(0)))


def track_stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as a stream, tracked with one state for each group."""
    folder = scratch(spark)
    snapshots(spark, sf_dir).repartition(1).sortWithinPartitions("frame_index").write.parquet(f"{folder}/in")
    schema = "group_key string, frame_index int, time_ps double, cage_id string, cage_type string, waters array<long>"
    found = track_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    done = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("frame_index", "track", "cage_id", "cage_type")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as a CSV table, arrays as JSON."""
    folder = scratch(spark)
    files.write_tables({"snapshots": snapshots(spark, sf_dir)}, folder, "csv")
    read = spark.read.option("header", "true").option("escape", '"').csv(f"{folder}/snapshots")
    members = F.from_json("waters", "array<bigint>")
    return read.select(F.col("frame_index").cast("int").alias("frame_index"), "cage_id", F.size(members).alias("members"), F.aggregate(members, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions as lines of a Markdown table."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").coalesce(1)
    lines = report.markdown_lines(rows)
    return lines.select("line")


FIXED = (gro_round_trip, gro_stacked, dump_round_trip, xyz_round_trip, frame_slices, pair_file, topology_letter, track_state_round_trip, track_stream_batches, csv_round_trip, markdown)

_ROWS = "rows_ AS (SELECT label::INTEGER AS f, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, embedding[1]::DOUBLE + 0.5 AS x, embedding[2]::DOUBLE + 0.5 AS y, embedding[3]::DOUBLE + 0.5 AS z FROM embeddings)"


def _sum_sql(value: str, more: str, where: str = "") -> str:
    parts = ", ".join(f"round(sum({value.format(c=c)} * k), 4) AS sum_{c}" for c in "xyz")
    return f"WITH {_ROWS} SELECT f AS frame_index, count(*) AS atoms{more}, {parts} FROM rows_ {where} GROUP BY f"


_THREE = "printf('%.3f', {c})::DOUBLE"


def _from_tracks(name: str) -> str:
    from latticework.plans import tracks

    return tracks.SQL[name]


SQL = {
    "gro_round_trip": _sum_sql(_THREE, ", f * 2.5::DOUBLE AS time_ps, 1.0::DOUBLE AS box"),
    "gro_stacked": _sum_sql(_THREE, ", f * 2.5::DOUBLE AS time_ps, 1.0::DOUBLE AS box", "WHERE k <= (SELECT min(n) FROM (SELECT max(k) AS n FROM rows_ GROUP BY f))"),
    "dump_round_trip": _sum_sql("printf('%.6f', {c})::DOUBLE", ", f * 1000.0::DOUBLE AS time_ps, 1.0::DOUBLE AS box"),
    "xyz_round_trip": _sum_sql("(printf('%.6f', {c} / 0.1)::DOUBLE * 0.1)", ""),
    "frame_slices": "SELECT label::INTEGER AS frame_index, count(*) AS atoms FROM embeddings WHERE label IN (2, 5, 7) GROUP BY label",
    "pair_file": "SELECT DISTINCT 3 * least(l_suppkey, l_partkey % 50) AS u, 3 * greatest(l_suppkey, l_partkey % 50) AS v FROM lineitem WHERE l_suppkey <> l_partkey % 50",
    "topology_letter": "SELECT f AS frame_index, n AS atoms, chr((64 + dense_rank() OVER (ORDER BY first))::INTEGER) AS letter FROM (SELECT *, min(f) OVER (PARTITION BY n) AS first FROM (SELECT s_nationkey::INTEGER AS f, count(*) AS n FROM supplier GROUP BY s_nationkey))",
    "track_state_round_trip": f"""WITH seen AS ({_from_tracks("track_observations")}), events AS ({_from_tracks("track_events")})
SELECT s.frame_index, s.cages, s.tracks, coalesce(e.n, 0) AS events FROM (SELECT frame_index, count(*) AS cages, array_to_string(list(substr(track, 2)::BIGINT ORDER BY substr(track, 2)::BIGINT), ' ') AS tracks FROM seen GROUP BY frame_index) s LEFT JOIN (SELECT frame_index, count(*) AS n FROM events GROUP BY frame_index) e ON e.frame_index = s.frame_index""",
    "track_stream_batches": f"SELECT frame_index, track, cage_id, cage_type FROM ({_from_tracks('track_observations')})",
    "csv_round_trip": """WITH steps AS (SELECT DISTINCT floor(epoch(ts - TIMESTAMP '2024-01-01') / 43200)::INTEGER AS s, event_type AS c, user_id AS w FROM events WHERE ts >= TIMESTAMP '2024-01-01')
SELECT f AS frame_index, c AS cage_id, count(*)::INTEGER AS members, sum(w)::BIGINT AS total FROM (SELECT DISTINCT s + k AS f, c, w FROM steps, (SELECT unnest([0, 1]) AS k) WHERE s + k <= (SELECT max(s) FROM steps)) GROUP BY f, c""",
    "markdown": "SELECT '| r_regionkey | r_name |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region",
}
