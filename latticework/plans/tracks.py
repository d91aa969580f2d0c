"""Queries over tracking snapshots and molecules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import reports, select, tracking
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K, joined
from latticework.sources.adapters import molecules, snapshots, table


def _seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tracking.track(snapshots(spark, sf_dir))


def track_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracking.match_candidates(snapshots(spark, sf_dir))
    return found.select("frame_index", "before", "after", "shared", F.round("jaccard", 6).alias("jaccard"), F.round("fraction", 6).alias("fraction"))


def track_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir)[0].select("frame_index", "time_ps", "track", "cage_id", "cage_type", F.size("waters").alias("waters"))


def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.events(*_seen(spark, sf_dir)).select("frame_index", "kind", "source", "destination")


def track_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.lifetimes(_seen(spark, sf_dir)[0]).drop("group_key")


def track_lifetime_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracking.lifetime_distribution(tracking.lifetimes(_seen(spark, sf_dir)[0]))
    return found.select("lifetime", "span", "tracks", *[F.round(c, 6).alias(c) for c in ("fraction", "cumulative", "survival")], "uncensored")


def track_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.population(_seen(spark, sf_dir)[0]).select("frame_index", "scope", "name", "n")


def track_guest_residence(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, _ = _seen(spark, sf_dir)
    guests = seen.select(*K, "cage_id", F.explode("waters").alias("guest")).where("guest % 50 = 0")
    return tracking.guest_residence(seen, guests).drop("group_key")


def track_member_residence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays of all members; track_guest_residence has those of one id in 50."""
    seen, _ = _seen(spark, sf_dir)
    return tracking.guest_residence(seen, seen.select(*K, "cage_id", F.explode("waters").alias("guest"))).drop("group_key")


def track_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks when a cage may be missing for a frame."""
    seen, _ = tracking.track(snapshots(spark, sf_dir), tracking.TrackingConfig(gap_frame=1))
    return seen.groupBy("track").agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count("*").alias("observed"))


def track_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of denser snapshots under loose thresholds, where assignment has a choice."""
    loose = tracking.TrackingConfig(min_jaccard=0.3, min_shared_fraction=0.4)
    seen, candidates = tracking.track(snapshots(spark, sf_dir, hours=6, window=4), loose)
    return tracking.events(seen, candidates).groupBy("kind").agg(F.count("*").alias("events"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots whose type and phases follow from how many members a cage has, so that they change."""
    n = F.size("waters")
    phases = F.when(n % 3 == 0, F.array(F.lit("sI"))).when(n % 3 == 1, F.array(F.lit("sI"), F.lit("sII"))).otherwise(F.array(F.lit("unclassified")))
    return snapshots(spark, sf_dir).withColumn("cage_type", F.when(n % 2 == 0, "512").otherwise("51262")).withColumn("phases", phases)


def _stamps(spark: SparkSession, sf_dir: str, more: int = 2) -> DataFrame:
    """Frames of the snapshots, and so many without a cage after them."""
    held = tracking.frame_table(snapshots(spark, sf_dir))
    last = held.agg(F.max("frame_index").alias("last")).select(F.lit("A").alias("group_key"), F.explode(F.sequence(F.col("last") + 1, F.col("last") + more)).alias("frame_index"))
    return checkpoint(held.unionByName(last.withColumn("time_ps", F.col("frame_index") * 12.0)))


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense snapshots from which each type is missing in every fourth frame."""
    return snapshots(spark, sf_dir, hours=6, window=4).where((F.col("frame_index") + F.length("cage_type")) % 4 != 0)


def track_gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of tracks that may miss a frame; a death is known once two frames have passed."""
    seen, candidates = tracking.track(_gappy(spark, sf_dir), tracking.TrackingConfig(gap_frame=1))
    return tracking.event_table(seen, candidates, gap_frame=1).drop("group_key")


def track_gap_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, _ = tracking.track(_gappy(spark, sf_dir), tracking.TrackingConfig(gap_frame=1))
    return tracking.lifetimes(seen, gap_frame=1).drop("group_key")


def track_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of type and phase along the tracks."""
    seen, candidates = tracking.track(_labelled(spark, sf_dir))
    return tracking.events(seen, candidates).where("kind IN ('type_change', 'phase_change')").select("frame_index", "kind", "source", "destination")


def track_phase_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cages by frame, type and phase label; empty frames have a total of 0."""
    seen, _ = tracking.track(_labelled(spark, sf_dir))
    return tracking.population(seen, _stamps(spark, sf_dir)).select("frame_index", "scope", "name", "n")


def track_empty_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two frames without a cage at the end: every track dies."""
    seen, candidates = tracking.track(snapshots(spark, sf_dir), frames=_stamps(spark, sf_dir))
    return tracking.events(seen, candidates, _stamps(spark, sf_dir)).select("frame_index", "kind", "source", "destination")


def track_empty_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = _stamps(spark, sf_dir)
    seen, _ = tracking.track(snapshots(spark, sf_dir), frames=stamps)
    return tracking.lifetimes(seen, stamps).select("track", "first_frame", "last_frame", "lifetime", "left_censored", "right_censored")


def track_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered in the order in which they come to be known."""
    return tracking.event_table(*tracking.track(_labelled(spark, sf_dir))).drop("group_key")


def track_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What led to each observation."""
    seen, _ = _seen(spark, sf_dir)
    return seen.select("frame_index", "track", "rank", F.round("jaccard", 6).alias("jaccard"), F.round("fraction", 6).alias("fraction"), F.round("topology_similarity", 6).alias("topology_similarity"), F.coalesce("gap", F.lit(-1)).alias("gap"))


def track_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetimes with duration status, types and phases of each track."""
    seen, _ = tracking.track(_labelled(spark, sf_dir))
    return tracking.track_table(seen).select("track", "gap_frames", "duration_status", "cage_types", "phases")


def track_censored_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays of members that begin or end with a censored track."""
    seen, _ = _seen(spark, sf_dir)
    guests = seen.select(*K, "cage_id", F.explode("waters").alias("guest"))
    found = tracking.guest_residence(seen, guests, tracking.lifetimes(seen))
    return found.groupBy("track", "left_censored", "right_censored").agg(F.count("*").alias("stays"))


def track_fans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and merges of denser snapshots under loose thresholds, by how many tracks they join."""
    loose = tracking.TrackingConfig(min_jaccard=0.3, min_shared_fraction=0.4)
    seen, candidates = tracking.track(snapshots(spark, sf_dir, hours=6, window=4), loose)
    found = tracking.events(seen, candidates).where("kind IN ('split', 'merge')")
    many = F.size(F.split(F.when(F.col("kind") == "split", F.col("destination")).otherwise(F.col("source")), " "))
    return found.groupBy("frame_index", "kind", many.alias("tracks")).agg(F.count("*").alias("events"))


def track_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the tracks that were a 51262 or in phase sII once."""
    seen, _ = tracking.track(_labelled(spark, sf_dir))
    kept = [reports.select_targets(seen, t).select(F.lit(t).alias("target"), "frame_index", "track") for t in ("51262", "sII", "t1")]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def frame_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults in the order of every other snapshot: each follows a gap."""
    return tracking.check_order(snapshots(spark, sf_dir).where("frame_index % 2 = 0")).select("frame_index", "fault")


def frame_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults in the order of all snapshots."""
    return tracking.check_order(snapshots(spark, sf_dir)).select("frame_index", "fault")


def time_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = snapshots(spark, sf_dir).select(*K, "time_ps").distinct()
    return select.sample_times(frames, 36.0).select("frame_index", "time_ps")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.residues(molecules(spark, sf_dir).withColumn("frame_index", (F.col("resid") % 8).cast("int")))


def molecule_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).groupBy("frame_index", "block", "resid", "resname")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("atom", "atomname"))), lambda a: a["atomname"]), "")
    return rows.agg(F.count("*").alias("atoms"), names.alias("names")).drop("block")


def molecule_waters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select.select_waters(_blocks(spark, sf_dir), ("1-URGENT", "2-HIGH"), ("N",), ("A", "R"))
    return found.select("frame_index", "resid", "resname", "atoms", F.col("oxygen.l_linenumber").alias("oxygen_line"), joined(F.transform("hydrogens", lambda h: h["l_linenumber"])).alias("hydrogen_lines"))


def molecule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms by residue name, and by role, in each frame."""
    role = select.roles(F.col("resname"), ("1-URGENT", "2-HIGH"), ("3-MEDIUM",), ("5-LOW",)).alias("role")
    return _blocks(spark, sf_dir).groupBy("frame_index", "resname", role).agg(F.count("*").alias("atoms"), F.countDistinct("block").alias("molecules"))


def topology_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame has a topology of its own here, so groups follow frames."""
    found = select.topology_groups(checkpoint(select.topology(_blocks(spark, sf_dir))))
    return found.select("frame_index", "atoms", F.col("group").cast("int").alias("topology"))


def pair_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pairs = _pairs(spark, sf_dir)
    return select.resolve_pairs(pairs, nodes)[0].select("u", "v")


def pair_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pairs = _pairs(spark, sf_dir)
    return select.resolve_pairs(pairs, nodes)[1].select("node")


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = [F.lit("A").alias("group_key"), F.lit(0).alias("frame_index")]
    nodes = table(spark, sf_dir, "supplier").select(*key, F.col("s_suppkey").alias("node"))
    return nodes, table(spark, sf_dir, "lineitem").select(*key, F.col("l_suppkey").alias("u"), (F.col("l_partkey") % 128).alias("v"))


FIXED = (track_candidates, track_observations, track_events, track_lifetimes, track_lifetime_distribution, track_population, track_guest_residence, track_member_residence, track_gaps, track_splits, track_gap_events, track_gap_lifetimes, track_changes, track_phase_population, track_empty_end, track_empty_lifetimes, track_event_ids, track_evidence, track_table, track_censored_stays, track_fans, track_targets, frame_order, frame_order_all, time_sampling, molecule_blocks, molecule_waters, molecule_counts, topology_groups, pair_edges, pair_unknown)

_SNAPS = """WITH RECURSIVE steps AS (SELECT DISTINCT floor(epoch(ts - TIMESTAMP '2024-01-01') / 43200)::INTEGER AS s, event_type AS c, user_id AS w FROM events WHERE ts >= TIMESTAMP '2024-01-01'),
members AS (SELECT DISTINCT s + k AS f, c, w FROM steps, (SELECT unnest([0, 1]) AS k) WHERE s + k <= (SELECT max(s) FROM steps)),
sizes AS (SELECT f, c, count(*) AS n, list(w ORDER BY w) AS ws FROM members GROUP BY f, c),
cand AS (
  SELECT b.f, a.c AS x, b.c AS y, count(*) AS shared, count(*) / (any_value(p.n) + any_value(q.n) - count(*)) AS jaccard, count(*) / least(any_value(p.n), any_value(q.n)) AS fraction
  FROM members a JOIN members b ON b.f = a.f + 1 AND b.w = a.w JOIN sizes p ON p.f = a.f AND p.c = a.c JOIN sizes q ON q.f = b.f AND q.c = b.c
  GROUP BY b.f, a.c, b.c HAVING count(*) >= 3 AND jaccard >= 0.5 AND fraction >= 0.6
), walk AS (
  SELECT f, c, f AS hf, c AS hc FROM sizes s WHERE NOT EXISTS (SELECT 1 FROM cand WHERE cand.f = s.f AND cand.y = s.c)
  UNION ALL SELECT cand.f, cand.y, hf, hc FROM walk JOIN cand ON cand.f = walk.f + 1 AND cand.x = walk.c
), heads AS (SELECT f, c, 't' || row_number() OVER (ORDER BY f, ws, c) AS track FROM (SELECT DISTINCT hf, hc FROM walk) h JOIN sizes ON f = hf AND c = hc),
seen AS (SELECT w.f, w.c, h.track, s.n, w.f * 12.0::DOUBLE AS t FROM walk w JOIN heads h ON h.f = w.hf AND h.c = w.hc JOIN sizes s ON s.f = w.f AND s.c = w.c),
life AS (
  SELECT track, min(f) AS first_frame, max(f) AS last_frame, count(*) AS observed, (max(f) - min(f) + 1)::BIGINT AS span, ((least(max(f) + 1, (SELECT max(f) FROM seen)) - min(f)) * 12)::DOUBLE AS lifetime,
    min(f) = (SELECT min(f) FROM seen) AS left_censored, max(f) = (SELECT max(f) FROM seen) AS right_censored, arg_min(c, f) AS initial_type, arg_max(c, f) AS final_type
  FROM seen GROUP BY track
) """
_MOLECULES = """WITH atoms AS (
  SELECT (l_orderkey % 8)::INTEGER AS f, l_orderkey AS resid, coalesce(o_orderpriority, 'NONE') AS resname, l_returnflag AS a, l_linenumber AS ln, row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
) """
SQL = {
    "track_candidates": _SNAPS + "SELECT f AS frame_index, x AS before, y AS after, shared, round(jaccard, 6) AS jaccard, round(fraction, 6) AS fraction FROM cand",
    "track_observations": _SNAPS + "SELECT f AS frame_index, t AS time_ps, track, c AS cage_id, c AS cage_type, n::INTEGER AS waters FROM seen",
    "track_events": _SNAPS + "SELECT first_frame AS frame_index, 'birth' AS kind, '' AS source, track AS destination FROM life UNION ALL SELECT last_frame + 1, 'death', track, '' FROM life WHERE NOT right_censored",
    "track_lifetimes": _SNAPS + "SELECT * FROM life",
    "track_lifetime_distribution": _SNAPS + """SELECT lifetime, span, n AS tracks, round(n / sum(n) OVER (), 6) AS fraction, round(sum(n) OVER (ORDER BY lifetime, span) / sum(n) OVER (), 6) AS cumulative,
  round(sum(n) OVER (ORDER BY lifetime RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(n) OVER (), 6) AS survival, uncensored
  FROM (SELECT lifetime, span, count(*) AS n, count(*) FILTER (NOT left_censored AND NOT right_censored) AS uncensored FROM life GROUP BY lifetime, span)""",
    "track_population": _SNAPS + "SELECT f AS frame_index, CASE WHEN c IS NULL THEN 'total' ELSE 'cage_type' END AS scope, coalesce(c, 'all') AS name, count(*) AS n FROM seen GROUP BY GROUPING SETS ((f), (f, c))",
    "track_guest_residence": _SNAPS + """SELECT track, w AS guest, row_number() OVER (PARTITION BY track, w ORDER BY min(f)) AS episode, min(f) AS start_frame, max(f) AS end_frame, count(*) AS observed, ((max(f) - min(f)) * 12)::DOUBLE AS residence
  FROM (SELECT s.track, m.w, s.f, s.f - row_number() OVER (PARTITION BY s.track, m.w ORDER BY s.f) AS island FROM seen s JOIN members m ON m.f = s.f AND m.c = s.c WHERE m.w % 50 = 0) GROUP BY track, w, island""",
    "frame_order": _SNAPS + "SELECT DISTINCT f AS frame_index, 'gap' AS fault FROM sizes WHERE f % 2 = 0 AND f > (SELECT min(f) FROM sizes WHERE f % 2 = 0)",
    "time_sampling": _SNAPS + "SELECT DISTINCT f AS frame_index, f * 12.0::DOUBLE AS time_ps FROM sizes WHERE (f - (SELECT min(f) FROM sizes)) % 3 = 0",
    "molecule_blocks": _MOLECULES + "SELECT f AS frame_index, resid, resname, count(*) AS atoms, string_agg(a, '' ORDER BY k, a) AS names FROM atoms GROUP BY f, resid, resname",
    "molecule_waters": _MOLECULES + """SELECT f AS frame_index, resid, resname, count(*) AS atoms, coalesce(min(k) FILTER (a = 'N'), CASE WHEN count(*) = 1 THEN min(k) END)[2] AS oxygen_line, coalesce(string_agg(ln::VARCHAR, ' ' ORDER BY k) FILTER (a IN ('A', 'R')), '') AS hydrogen_lines
  FROM atoms WHERE resname IN ('1-URGENT', '2-HIGH') GROUP BY f, resid, resname HAVING count(*) FILTER (a = 'N') > 0 OR count(*) = 1""",
    "molecule_counts": _MOLECULES + "SELECT f AS frame_index, resname, CASE WHEN resname IN ('1-URGENT', '2-HIGH') THEN 'water' WHEN resname = '3-MEDIUM' THEN 'guest' WHEN resname = '5-LOW' THEN 'additive' ELSE 'unknown' END AS role, count(*) AS atoms, count(DISTINCT resid) AS molecules FROM atoms GROUP BY f, resname",
    "topology_groups": _MOLECULES + "SELECT f AS frame_index, count(*) AS atoms, (row_number() OVER (ORDER BY f))::INTEGER AS topology FROM atoms GROUP BY f",
    "pair_edges": "SELECT DISTINCT least(l_suppkey, l_partkey % 128) AS u, greatest(l_suppkey, l_partkey % 128) AS v FROM lineitem WHERE l_suppkey <> l_partkey % 128 AND l_partkey % 128 IN (SELECT s_suppkey FROM supplier) AND l_suppkey IN (SELECT s_suppkey FROM supplier)",
    "pair_unknown": "SELECT node FROM (SELECT l_suppkey AS node FROM lineitem WHERE l_suppkey <> l_partkey % 128 UNION SELECT l_partkey % 128 FROM lineitem WHERE l_suppkey <> l_partkey % 128) WHERE node NOT IN (SELECT s_suppkey FROM supplier)",
}
_RANKS = """rk AS (SELECT f, c, row_number() OVER (PARTITION BY f ORDER BY ws, CASE n % 2 WHEN 0 THEN '512' ELSE '51262' END, c) AS rk FROM sizes),
lab AS (SELECT s.f, s.c, s.track, k.rk, CASE s.n % 2 WHEN 0 THEN '512' ELSE '51262' END AS t, CASE s.n % 3 WHEN 0 THEN 'sI' WHEN 1 THEN 'sI,sII' ELSE 'unclassified' END AS ph FROM seen s JOIN rk k ON k.f = s.f AND k.c = s.c),
was AS (SELECT *, lag(t) OVER w AS t0, lag(ph) OVER w AS ph0 FROM lab WINDOW w AS (PARTITION BY track ORDER BY f)) """
_LABELLED = _SNAPS.rstrip() + ", " + _RANKS
_LAST = "(SELECT max(f) FROM seen)"
_RESIDENCE = SQL["track_guest_residence"].replace(" WHERE m.w % 50 = 0", "")
# a track lives on over one missed frame unless a later one fits better; by type, as no two types ever match
_GAPS = _SNAPS.rstrip() + """, two AS (
  SELECT b.f, a.c, count(*) / (any_value(p.n) + any_value(q.n) - count(*)) AS jaccard, count(*) / least(any_value(p.n), any_value(q.n)) AS fraction
  FROM members a JOIN members b ON b.f = a.f + 2 AND b.w = a.w AND b.c = a.c JOIN sizes p ON p.f = a.f AND p.c = a.c JOIN sizes q ON q.f = b.f AND q.c = b.c
  GROUP BY b.f, a.c HAVING count(*) >= 3 AND jaccard >= 0.5 AND fraction >= 0.6
), chain AS (
  SELECT s.f, s.c, s.f AS cur, NULL::INTEGER AS prev FROM sizes s WHERE s.f = (SELECT min(f) FROM sizes)
  UNION ALL
  SELECT s.f, s.c, CASE WHEN o.jaccard IS NOT NULL AND (t.jaccard IS NULL OR k.prev IS NULL OR k.prev = k.cur OR 100 * o.jaccard + 10 * o.fraction >= 100 * t.jaccard + 10 * t.fraction - 0.01) THEN k.cur
    WHEN t.jaccard IS NOT NULL AND k.prev IS NOT NULL AND k.prev <> k.cur THEN k.prev ELSE s.f END, k.cur
  FROM chain k JOIN sizes s ON s.f = k.f + 1 AND s.c = k.c LEFT JOIN cand o ON o.f = s.f AND o.x = s.c AND o.y = s.c LEFT JOIN two t ON t.f = s.f AND t.c = s.c
), named AS (SELECT h.cur, h.c, row_number() OVER (ORDER BY h.cur, s.ws, h.c) AS track FROM (SELECT DISTINCT cur, c FROM chain) h JOIN sizes s ON s.f = h.cur AND s.c = h.c) """
_DENSE = """WITH steps AS (SELECT DISTINCT floor(epoch(ts - TIMESTAMP '2024-01-01') / 21600)::INTEGER AS s, event_type AS c, user_id AS w FROM events WHERE ts >= TIMESTAMP '2024-01-01'),
members AS (SELECT DISTINCT s + k AS f, c, w FROM steps, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE s + k <= (SELECT max(s) FROM steps)), sizes AS (SELECT f, c, count(*) AS n FROM members GROUP BY f, c),
cand AS (
  SELECT b.f, a.c AS x, b.c AS y FROM members a JOIN members b ON b.f = a.f + 1 AND b.w = a.w JOIN sizes p ON p.f = a.f AND p.c = a.c JOIN sizes q ON q.f = b.f AND q.c = b.c
  GROUP BY b.f, a.c, b.c HAVING count(*) >= 3 AND count(*) / (any_value(p.n) + any_value(q.n) - count(*)) >= 0.3 AND count(*) / least(any_value(p.n), any_value(q.n)) >= 0.4
) """
SQL |= {
    "track_member_residence": _RESIDENCE,
    "track_gaps": _GAPS + "SELECT 't' || track AS track, min(f) AS first_frame, max(f) AS last_frame, count(*) AS observed FROM chain JOIN named USING (cur, c) GROUP BY track",
    "track_changes": _LABELLED + "SELECT f AS frame_index, 'type_change' AS kind, track AS source, track AS destination FROM was WHERE t <> t0 UNION ALL SELECT f, 'phase_change', track, track FROM was WHERE ph <> ph0",
    "track_phase_population": _LABELLED + f"SELECT f AS frame_index, CASE WHEN t IS NULL THEN 'total' ELSE 'cage_type' END AS scope, coalesce(t, 'all') AS name, count(*) AS n FROM lab GROUP BY GROUPING SETS ((f), (f, t)) UNION ALL SELECT f, 'phase', p, count(*) FROM (SELECT f, unnest(string_split(ph, ',')) AS p FROM lab) GROUP BY f, p UNION ALL SELECT {_LAST} + k, 'total', 'all', 0 FROM (SELECT unnest([1, 2]) AS k)",
    "track_empty_end": _SNAPS + "SELECT first_frame AS frame_index, 'birth' AS kind, '' AS source, track AS destination FROM life UNION ALL SELECT last_frame + 1, 'death', track, '' FROM life",
    "track_empty_lifetimes": _SNAPS + "SELECT track, first_frame, last_frame, (span * 12)::DOUBLE AS lifetime, left_censored, false AS right_censored FROM life",
    "track_event_ids": _LABELLED + """, ev AS (
  SELECT f, 'birth' AS kind, '' AS source, track AS destination, 0 AS stage, rk, 0 AS turn FROM was WHERE t0 IS NULL UNION ALL SELECT f, 'type_change', track, track, 1, rk, 0 FROM was WHERE t <> t0 UNION ALL SELECT f, 'phase_change', track, track, 1, rk, 1 FROM was WHERE ph <> ph0
  UNION ALL SELECT l.f + 1, 'death', l.track, '', 4, l.rk, 0 FROM lab l JOIN life ON life.track = l.track AND life.last_frame = l.f AND NOT right_censored
) SELECT f AS frame_index, 'e' || row_number() OVER (ORDER BY f, stage, rk, turn) AS event_id, kind, source, destination, kind = 'birth' AND f = (SELECT min(f) FROM seen) AS censored FROM ev""",
    "track_evidence": _SNAPS.rstrip() + ", rk AS (SELECT f, c, row_number() OVER (PARTITION BY f ORDER BY ws, c) AS rk FROM sizes) SELECT s.f AS frame_index, s.track, k.rk::INTEGER AS rank, round(d.jaccard, 6) AS jaccard, round(d.fraction, 6) AS fraction, CASE WHEN d.f IS NOT NULL THEN 0.0 END AS topology_similarity, CASE WHEN d.f IS NOT NULL THEN 0 ELSE -1 END AS gap FROM seen s JOIN rk k ON k.f = s.f AND k.c = s.c LEFT JOIN cand d ON d.f = s.f AND d.y = s.c",
    "track_table": _LABELLED + """, firsts AS (SELECT track, t, min(f) AS f FROM lab GROUP BY track, t), labels AS (SELECT track, p, min(f) AS f FROM (SELECT track, f, unnest(string_split(ph, ',')) AS p FROM lab) GROUP BY track, p)
SELECT track, 0::BIGINT AS gap_frames, CASE WHEN left_censored AND right_censored THEN 'left_and_right_censored_lower_bound' WHEN left_censored THEN 'left_censored_lower_bound' WHEN right_censored THEN 'right_censored_lower_bound' ELSE 'complete' END AS duration_status,
  (SELECT string_agg(t, ',' ORDER BY f, t) FROM firsts x WHERE x.track = life.track) AS cage_types, (SELECT string_agg(p, ',' ORDER BY f, p) FROM labels x WHERE x.track = life.track) AS phases FROM life""",
    "track_censored_stays": f"WITH stays AS ({_RESIDENCE}), lives AS ({SQL['track_lifetimes']}) SELECT track, left_censored AND start_frame = first_frame AS left_censored, right_censored AND end_frame = last_frame AS right_censored, count(*) AS stays FROM stays JOIN lives USING (track) GROUP BY ALL",
    "track_fans": _DENSE + "SELECT f AS frame_index, 'split' AS kind, n::INTEGER AS tracks, count(*) AS events FROM (SELECT f, x, count(*) AS n FROM cand GROUP BY f, x HAVING count(*) > 1) GROUP BY f, n UNION ALL SELECT f, 'merge', n::INTEGER, count(*) FROM (SELECT f, y, count(*) AS n FROM cand GROUP BY f, y HAVING count(*) > 1) GROUP BY f, n",
    "track_targets": _LABELLED + "SELECT '51262' AS target, f AS frame_index, track FROM lab WHERE track IN (SELECT track FROM lab WHERE t = '51262') UNION ALL SELECT 'sII', f, track FROM lab WHERE track IN (SELECT track FROM lab WHERE ph = 'sI,sII') UNION ALL SELECT 't1', f, track FROM lab WHERE track = 't1'",
    "frame_order_all": _SNAPS + "SELECT f AS frame_index, 'gap' AS fault FROM (SELECT f, lag(f) OVER (ORDER BY f) AS p FROM (SELECT DISTINCT f FROM sizes)) WHERE f <> p + 1",
}
_MISSING = _DENSE[: _DENSE.index("cand AS")].replace("sizes AS (SELECT f, c, count(*) AS n FROM members GROUP BY f, c)", "sizes AS (SELECT f, c, count(*) AS n, list(w ORDER BY w) AS ws FROM members WHERE (f + length(c)) % 4 <> 0 GROUP BY f, c)").replace("WITH ", "WITH RECURSIVE ") + """link AS (
  SELECT q.f, q.c, q.f - p.f AS d, count(*) / (any_value(p.n) + any_value(q.n) - count(*)) AS jaccard, count(*) / least(any_value(p.n), any_value(q.n)) AS fraction
  FROM sizes p JOIN sizes q ON q.c = p.c AND q.f - p.f IN (1, 2) JOIN members a ON a.f = p.f AND a.c = p.c JOIN members b ON b.f = q.f AND b.c = q.c AND b.w = a.w
  GROUP BY q.f, q.c, p.f HAVING count(*) >= 3 AND jaccard >= 0.5 AND fraction >= 0.6
), grid AS (SELECT g.f, t.c, s.n IS NOT NULL AS here FROM (SELECT unnest(range((SELECT min(f) FROM sizes), (SELECT max(f) + 1 FROM sizes)))::INTEGER AS f) g, (SELECT DISTINCT c FROM sizes) t LEFT JOIN sizes s ON s.f = g.f AND s.c = t.c),
chain AS (
  SELECT f, c, CASE WHEN here THEN f END AS now, NULL::INTEGER AS old FROM grid WHERE f = (SELECT min(f) FROM grid)
  UNION ALL
  SELECT g.f, g.c, CASE WHEN NOT g.here THEN NULL WHEN k.now IS NOT NULL AND o.d IS NOT NULL AND NOT (k.old IS NOT NULL AND k.old <> k.now AND t.d IS NOT NULL AND 100 * t.jaccard + 10 * t.fraction - 0.01 > 100 * o.jaccard + 10 * o.fraction) THEN k.now
    WHEN k.old IS NOT NULL AND k.old IS DISTINCT FROM k.now AND t.d IS NOT NULL THEN k.old ELSE g.f END, k.now
  FROM chain k JOIN grid g ON g.f = k.f + 1 AND g.c = k.c LEFT JOIN link o ON o.f = g.f AND o.c = g.c AND o.d = 1 LEFT JOIN link t ON t.f = g.f AND t.c = g.c AND t.d = 2
), named AS (SELECT h.now, h.c, 't' || row_number() OVER (ORDER BY h.now, s.ws, h.c) AS track, row_number() OVER (ORDER BY h.now, s.ws, h.c) AS num FROM (SELECT DISTINCT now, c FROM chain WHERE now IS NOT NULL) h JOIN sizes s ON s.f = h.now AND s.c = h.c),
seen AS (SELECT k.f, k.c, n.track, n.num, row_number() OVER (PARTITION BY k.f ORDER BY s.ws, k.c) AS rk, lag(k.f) OVER (PARTITION BY n.track ORDER BY k.f) AS p, lead(k.f) OVER (PARTITION BY n.track ORDER BY k.f) AS q FROM chain k JOIN named n ON n.now = k.now AND n.c = k.c JOIN sizes s ON s.f = k.f AND s.c = k.c) """
SQL |= {
    "track_gap_events": _MISSING + """, ev AS (
  SELECT f, f AS known, CASE WHEN p IS NULL THEN 'birth' ELSE 'gap' END AS kind, CASE WHEN p IS NULL THEN '' ELSE track END AS source, track AS destination, 0 AS stage, rk AS place FROM seen WHERE p IS NULL OR f - p > 1
  UNION ALL SELECT f + 1, f + 2, 'death', track, '', 4, num FROM seen WHERE q IS NULL AND (SELECT max(f) FROM seen) - f > 1
) SELECT f AS frame_index, 'e' || row_number() OVER (ORDER BY known, stage, place) AS event_id, kind, source, destination, kind = 'birth' AND f = (SELECT min(f) FROM seen) AS censored FROM ev""",
    "track_gap_lifetimes": _MISSING + """SELECT track, min(f) AS first_frame, max(f) AS last_frame, count(*) AS observed, (max(f) - min(f) + 1)::BIGINT AS span, ((max(f) + CASE WHEN (SELECT max(f) FROM seen) - max(f) > 1 THEN 1 ELSE 0 END - min(f)) * 6)::DOUBLE AS lifetime,
  min(f) = (SELECT min(f) FROM seen) AS left_censored, (SELECT max(f) FROM seen) - max(f) <= 1 AS right_censored, arg_min(c, f) AS initial_type, arg_max(c, f) AS final_type FROM seen GROUP BY track""",
}
