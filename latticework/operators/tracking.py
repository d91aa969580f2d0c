"""Cages across frames: candidates, assignment, tracks, events and lifetime tables.

With no gap allowed, links between consecutive frames are independent of each other: every
frame pair is matched in parallel, and tracks are the components of the links. A gap makes
matching depend on earlier matches; ``link_with_gaps`` folds a group's snapshots in order and
holds live tracks only.

Snapshots are (K, time_ps, cage_id, cage_type, waters), waters being a sorted array. They may
also have a centre (cx, cy, cz in the box lx, ly, lz), topology (sizes of the faces), guests
and phases (labels); what is not there adds nothing to a match. Frames are (K, time_ps): all
frames, those without a cage included. Without that table the frames of snapshots count.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.pbc import delta, norm, vec
from latticework.operators.checkpoints import checkpoint
from latticework.operators.graphs import K, components

#: What a snapshot may have besides its key, and what an observation carries on.
OPTIONAL = {"cx": "double", "cy": "double", "cz": "double", "lx": "double", "ly": "double", "lz": "double", "topology": "array<int>", "guests": "array<string>", "phases": "array<string>"}
EVIDENCE = ["jaccard", "fraction", "distance", "topology_similarity", "gap"]


@dataclass(frozen=True)
class TrackingConfig:
    min_jaccard: float = 0.5
    min_shared_fraction: float = 0.6
    min_shared_waters: int = 3
    gap_frame: int = 0
    max_center_distance_nm: float | None = None
    guest_tiebreak: bool = True

    def __post_init__(self) -> None:
        if not (0 <= self.min_jaccard <= 1 and 0 <= self.min_shared_fraction <= 1):
            raise ValueError("thresholds must lie between 0 and 1")
        if self.min_shared_waters < 1 or self.gap_frame < 0:
            raise ValueError("min_shared_waters must be 1 or more, gap_frame 0 or more")
        if self.max_center_distance_nm is not None and self.max_center_distance_nm <= 0:
            raise ValueError("max_center_distance_nm must be positive")


def frame_table(snapshots: DataFrame) -> DataFrame:
    """(K, time_ps) of the frames that have a cage."""
    return snapshots.groupBy(*K).agg(F.min("time_ps").alias("time_ps"))


def check_order(snapshots: DataFrame) -> DataFrame:
    """(group_key, frame_index, fault): frames that don't follow the one before, or go back in time."""
    frames = frame_table(snapshots)
    order = Window.partitionBy("group_key").orderBy("frame_index")
    step = F.col("frame_index") - F.lag("frame_index").over(order)
    back = F.col("time_ps") < F.lag("time_ps").over(order)
    return frames.select(*K, F.when(step != 1, "gap").when(back, "time").alias("fault")).where("fault IS NOT NULL")


def multiset_similarity(a: Column, b: Column) -> Column:
    """Common part of two arrays over their union, repeats counted; 0 for two empty ones."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    total = lambda pick: F.aggregate(F.array_union(a, b), F.lit(0), lambda s, v: s + pick(count(a, v), count(b, v)))
    return F.when(F.size(F.array_union(a, b)) > 0, total(F.least) / total(F.greatest)).otherwise(0.0)


def _filled(snapshots: DataFrame) -> DataFrame:
    """Snapshots with all OPTIONAL columns; missing arrays are empty."""
    out = snapshots
    for name, kind in OPTIONAL.items():
        value = F.col(name).cast(kind) if name in snapshots.columns else F.lit(None).cast(kind)
        out = out.withColumn(name, F.coalesce(value, F.array().cast(kind)) if kind.startswith("array") else value)
    return out


def match_candidates(snapshots: DataFrame, config: TrackingConfig | None = None) -> DataFrame:
    """(K, before, after, shared, jaccard, fraction): pairs of cages of a frame and the next that share enough waters."""
    config = config or TrackingConfig()
    members = snapshots.select(*K, "cage_id", F.size("waters").alias("n"), F.explode("waters").alias("water"))
    old = members.select("group_key", (F.col("frame_index") + 1).alias("frame_index"), F.col("cage_id").alias("before"), F.col("n").alias("n_before"), "water")
    new = members.select(*K, F.col("cage_id").alias("after"), F.col("n").alias("n_after"), "water")
    met = old.join(new, [*K, "water"]).groupBy(*K, "before", "after", "n_before", "n_after").agg(F.count("*").alias("shared"))
    jaccard = F.col("shared") / (F.col("n_before") + F.col("n_after") - F.col("shared"))
    fraction = F.col("shared") / F.least("n_before", "n_after")
    scored = met.select(*K, "before", "after", "shared", jaccard.alias("jaccard"), fraction.alias("fraction"))
    return scored.where((F.col("shared") >= config.min_shared_waters) & (F.col("jaccard") >= config.min_jaccard) & (F.col("fraction") >= config.min_shared_fraction))


def with_evidence(candidates: DataFrame, snapshots: DataFrame, config: TrackingConfig) -> DataFrame:
    """Candidates with distance (null without centres), topology_similarity, guest_similarity and gap; those too far apart are left out."""
    full = _filled(snapshots)
    what = ["cx", "cy", "cz", "lx", "ly", "lz", "topology", "guests"]
    end = lambda name, p, back: full.select("group_key", (F.col("frame_index") + back).alias("frame_index"), F.col("cage_id").alias(name), *[F.col(c).alias(f"{p}{c}") for c in what])
    both = candidates.join(end("before", "p", 1), [*K, "before"]).join(end("after", "q", 0), [*K, "after"])
    away = norm(delta(vec("pc"), vec("qc"), vec("ql")))
    guests = F.size(F.array_union("pguests", "qguests"))
    alike = F.when(guests > 0, F.size(F.array_intersect("pguests", "qguests")) / guests).otherwise(0.0)
    found = both.select(*candidates.columns, away.alias("distance"), multiset_similarity(F.col("ptopology"), F.col("qtopology")).alias("topology_similarity"), alike.alias("guest_similarity"), F.lit(0).alias("gap"))
    if config.max_center_distance_nm is None:
        return found
    return found.where(F.coalesce(F.col("distance") <= config.max_center_distance_nm, F.lit(True)))


def quality(jaccard: float, fraction: float, distance: float | None, topology: float, guests: float, gap: int, config: TrackingConfig) -> float:
    """Worth of a link; how many links there are comes first."""
    near = 0.0 if distance is None else 1.0 / (1.0 + distance)
    return 100.0 * jaccard + 10.0 * fraction + near + topology + (0.001 * guests if config.guest_tiebreak else 0.0) - 0.01 * gap


def best_matching(weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """A matching of the most pairs and, among those, of the largest total weight.

    Augmenting paths of largest gain over the sparse candidates, one component at a time.
    """
    near: dict[tuple[int, str], list[tuple[int, str]]] = defaultdict(list)
    for a, b in weights:
        near[0, a].append((1, b))
        near[1, b].append((0, a))
    done: set[tuple[int, str]] = set()
    result = []
    for start in sorted(near):
        if start in done:
            continue
        part, stack = {start}, [start]
        while stack:
            for x in near[stack.pop()]:
                if x not in part:
                    part.add(x)
                    stack.append(x)
        done |= part
        pairs = sorted((a, b) for side, a in part if side == 0 for _, b in near[0, a])
        result += _augment(pairs, weights)
    return sorted(result)


def _augment(pairs: list[tuple[str, str]], weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    partner: dict[str, str] = {}  # of right ends
    taken: dict[str, str] = {}  # of left ends
    while True:
        gain = {a: 0.0 for a, _ in pairs if a not in taken}
        reach: dict[str, tuple[float, str]] = {}
        moved = True
        while moved:
            moved = False
            for a, b in pairs:
                if a not in gain or taken.get(a) == b:
                    continue
                value = gain[a] + weights[a, b]
                if b not in reach or value > reach[b][0] + 1e-12:
                    reach[b] = (value, a)
                    moved = True
                    if b in partner:
                        back = value - weights[partner[b], b]
                        if back > gain.get(partner[b], float("-inf")) + 1e-12:
                            gain[partner[b]] = back
        free = [b for b in reach if b not in partner]
        if not free:
            return [(a, b) for b, a in partner.items()]
        b = max(free, key=lambda x: (reach[x][0], x))
        while True:
            a = reach[b][1]
            before = taken.get(a)
            partner[b], taken[a] = a, b
            if before is None:
                break
            del partner[before]
            b = before


def assign(candidates: DataFrame, config: TrackingConfig | None = None) -> DataFrame:
    """(K, before, after, EVIDENCE): one-to-one links, as many as possible and then the best by quality.

    Candidates of with_evidence. Ends of one candidate are settled at once; only the others
    need the kernel, one connected set of candidates at a time.
    """
    config = config or TrackingConfig()
    near = F.when(F.col("distance").isNull(), 0.0).otherwise(1.0 / (1.0 + F.col("distance")))
    worth = 100 * F.col("jaccard") + 10 * F.col("fraction") + near + F.col("topology_similarity") + (0.001 if config.guest_tiebreak else 0.0) * F.col("guest_similarity")
    rows = candidates.withColumn("weight", worth)
    sides = rows.select("*", F.count("*").over(Window.partitionBy(*K, "before")).alias("p"), F.count("*").over(Window.partitionBy(*K, "after")).alias("q"))
    sides = checkpoint(sides)
    plain = sides.where("p = 1 AND q = 1").select(*K, "before", "after", *EVIDENCE)
    tied = sides.where("p > 1 OR q > 1").drop("p", "q")
    # both ends as numbers of one graph, so that each connected set of candidates is solved alone
    left, right = F.pmod(F.xxhash64(F.lit(0), "before"), F.lit(1 << 62)), F.pmod(F.xxhash64(F.lit(1), "after"), F.lit(1 << 62))
    ties = tied.select(*K, left.alias("u"), right.alias("v"), "before", "after", "weight")
    labels = components(ties.select(*K, F.col("u").alias("node")).distinct(), ties).withColumnRenamed("node", "u")

    def solve(pairs: pd.DataFrame) -> pd.DataFrame:
        found = best_matching({(a, b): w for a, b, w in zip(pairs["before"], pairs["after"], pairs["weight"], strict=True)})
        return pd.DataFrame([(pairs["group_key"].iloc[0], pairs["frame_index"].iloc[0], a, b) for a, b in found], columns=[*K, "before", "after"])

    grouped = ties.join(labels, [*K, "u"]).groupBy(*K, "component")
    solved = grouped.applyInPandas(solve, "group_key string, frame_index int, before string, after string")
    return plain.unionByName(tied.join(solved, [*K, "before", "after"]).select(*plain.columns))


def observations(snapshots: DataFrame, links: DataFrame) -> DataFrame:
    """Snapshots with track, numbered by first frame, then by waters, type and id; rank, the place in that order within a frame; and EVIDENCE of the link that led there."""
    rank = F.row_number().over(Window.partitionBy(*K).orderBy("waters", "cage_type", "cage_id"))
    nodes = checkpoint(snapshots.select("*", rank.alias("rank"), (F.col("frame_index").cast("long") * F.lit(1 << 32) + rank).alias("node")))
    flat = nodes.select("group_key", F.lit(0).alias("frame_index"), "node")
    end = lambda c, n: nodes.select(*K, F.col("cage_id").alias(c), F.col("node").alias(n))
    ties = links.join(end("after", "v"), [*K, "after"]).withColumn("frame_index", F.col("frame_index") - 1).join(end("before", "u"), [*K, "before"])
    labels = checkpoint(components(flat, ties.select("group_key", F.lit(0).alias("frame_index"), "u", "v")))
    numbers = _numbered(labels.select("group_key", "component").distinct())
    named = labels.join(numbers, ["group_key", "component"]).select("group_key", "node", F.concat(F.lit("t"), "track").alias("track"))
    led = links.select(*K, F.col("after").alias("cage_id"), *EVIDENCE)
    return nodes.join(named, ["group_key", "node"]).join(led, [*K, "cage_id"], "left").drop("node")


def _numbered(tracks: DataFrame) -> DataFrame:
    """Tracks of each group numbered by component, frame by frame, so that no task orders a whole group."""
    born = tracks.withColumn("born", F.shiftright("component", 32))
    within = F.row_number().over(Window.partitionBy("group_key", "born").orderBy("component"))
    before = Window.partitionBy("group_key").orderBy("born").rowsBetween(Window.unboundedPreceding, -1)
    skip = born.groupBy("group_key", "born").agg(F.count("*").alias("n")).select("group_key", "born", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return born.withColumn("k", within).join(skip, ["group_key", "born"]).select("group_key", "component", (F.col("skip") + F.col("k")).alias("track"))


def track(snapshots: DataFrame, config: TrackingConfig | None = None, frames: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(observations, candidates); with frames, these must be consecutive and in order of time, else it raises."""
    config = config or TrackingConfig()
    snapshots = checkpoint(snapshots)
    if frames is not None:
        faults = check_order(frames).orderBy(*K).limit(5).collect()
        if faults:
            raise ValueError("frames must be consecutive and in order of time: " + ", ".join(f"{f.group_key} {f.frame_index} ({f.fault})" for f in faults))
    if config.gap_frame:
        return link_with_gaps(snapshots, config)
    candidates = checkpoint(with_evidence(match_candidates(snapshots, config), snapshots, config))
    return checkpoint(observations(snapshots, checkpoint(assign(candidates, config)))), candidates


def link_with_gaps(snapshots: DataFrame, config: TrackingConfig) -> tuple[DataFrame, DataFrame]:
    """(observations, candidates) where a track may be missing for up to gap_frame frames.

    Each group is folded in order of its frames, in one pass that holds a frame and the live
    tracks. A candidate's before is the cage of gap + 1 frames ago.
    """
    full = _filled(snapshots)
    state = ["cage_id", "cage_type", "waters", *OPTIONAL]
    out = "group_key string, frame_index int, kind string, cage_id string, other string, track long, rank int, gap int, shared long, jaccard double, fraction double, distance double, topology_similarity double, guest_similarity double"
    names = [c.split()[0] for c in out.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in out.split(", ")])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tracker, held, rows = None, Tracker(config), [], []

        def close() -> None:
            if key is None:
                return
            for rank, (n, s) in enumerate(tracker.step(key[1], held), 1):
                led = tracker.evidence.get(n, {})
                rows.append((*key, "seen", s[0], None, n, rank, *(led.get(c) for c in names[7:])))
            rows.extend((*key, "candidate", c["after"], c["before"], c["track"], None, *(c[x] for x in names[7:])) for c in tracker.candidates)

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for g, f, *cage in zip(*cols, strict=True):
                if (g, f) != key:
                    close()
                    if key is None or key[0] != g:
                        tracker = Tracker(config)
                    key, held = (g, f), []
                held.append((cage[0], cage[1], tuple(cage[2]), dict(zip(OPTIONAL, cage[3:], strict=True))))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    dealt = full.select(*K, *state).repartition("group_key").sortWithinPartitions(*K, "waters", "cage_type", "cage_id")
    folded = checkpoint(dealt.mapInArrow(kernel, out))
    seen = folded.where("kind = 'seen'").select(*K, "cage_id", F.concat(F.lit("t"), "track").alias("track"), "rank", *EVIDENCE)
    asked = folded.where("kind = 'candidate'").select(*K, F.col("other").alias("before"), F.col("cage_id").alias("after"), "shared", "jaccard", "fraction", "distance", "topology_similarity", "guest_similarity", "gap")
    return checkpoint(snapshots.join(seen, [*K, "cage_id"])), asked


class Tracker:
    """State of one group between frames: live and dormant tracks by number."""

    def __init__(self, config: TrackingConfig) -> None:
        self.config, self.count = config, 0
        #: By track: last frame, waters, and what else the last cage had.
        self.live: dict[int, tuple[int, frozenset[int], dict]] = {}
        #: Of the last step: all candidates, and those that were chosen, by track.
        self.candidates: list[dict] = []
        self.evidence: dict[int, dict] = {}

    def step(self, frame: int, states: list[tuple]) -> list[tuple[int, tuple]]:
        """(track, state) of a frame's cages (id, type, waters, and perhaps a dict of what else there is)."""
        config = self.config
        states = sorted(states, key=lambda s: (s[2], s[1], s[0]))
        self.live = {n: x for n, x in self.live.items() if frame - x[0] - 1 <= config.gap_frame}
        holders: dict[int, list[int]] = defaultdict(list)
        for n, (_, waters, _) in self.live.items():
            for w in waters:
                holders[w].append(n)
        weights, self.candidates, made = {}, [], {}
        for k, (cage, _, waters, *more) in enumerate(states):
            shared: dict[int, int] = defaultdict(int)
            for w in waters:
                for n in holders[w]:
                    shared[n] += 1
            for n, common in shared.items():
                last, old, was = self.live[n]
                now = more[0] if more else {}
                jaccard, fraction = common / (len(old) + len(waters) - common), common / min(len(old), len(waters))
                if common < config.min_shared_waters or jaccard < config.min_jaccard or fraction < config.min_shared_fraction:
                    continue
                away = _distance(was, now)
                if config.max_center_distance_nm is not None and away is not None and away > config.max_center_distance_nm:
                    continue
                alike, guests = _multiset(was.get("topology"), now.get("topology")), _jaccard(was.get("guests"), now.get("guests"))
                pair = f"{n:012d}", f"{k:09d}"
                weights[pair] = quality(jaccard, fraction, away, alike, guests, frame - last - 1, config)
                made[pair] = {
                    "before": was.get("cage_id"), "after": cage, "track": n, "gap": frame - last - 1, "shared": common, "jaccard": jaccard, "fraction": fraction,
                    "distance": away, "topology_similarity": alike, "guest_similarity": guests,
                }
        self.candidates = [made[p] for p in sorted(made)]
        chosen = best_matching(weights)
        matched = {int(b): int(a) for a, b in chosen}
        self.evidence = {int(a): made[a, b] for a, b in chosen}
        out = []
        for k, state in enumerate(states):
            if k not in matched:
                self.count += 1
            n = matched.get(k, self.count)
            self.live[n] = (frame, frozenset(state[2]), {"cage_id": state[0], **(state[3] if len(state) > 3 else {})})
            out.append((n, state))
        return out


def _distance(a: dict, b: dict) -> float | None:
    gaps = []
    for c in "xyz":
        p, q, n = a.get(f"c{c}"), b.get(f"c{c}"), b.get(f"l{c}")
        if p is None or q is None:
            return None
        gaps.append(q - p if n is None else q - p - n * round((q - p) / n))
    return math.sqrt(sum(d * d for d in gaps))


def _multiset(a: list | None, b: list | None) -> float:
    x, y = Counter(a or ()), Counter(b or ())
    either = sum((x | y).values())
    return sum((x & y).values()) / either if either else 0.0


def _jaccard(a: list | None, b: list | None) -> float:
    x, y = set(a or ()), set(b or ())
    return len(x & y) / len(x | y) if x | y else 0.0


def _ends(frames: DataFrame) -> DataFrame:
    return frames.groupBy("group_key").agg(F.min("frame_index").alias("begin"), F.max("frame_index").alias("end"))


def events(seen: DataFrame, candidates: DataFrame, frames: DataFrame | None = None, gap_frame: int = 0) -> DataFrame:
    """(K, kind, source, destination): births, gaps, deaths, changes of type and phase, splits and merges.

    Deaths are stamped at the first frame without the track, and known once more than
    gap_frame frames have passed. Splits and merges count all candidates, not only assigned
    ones. Phases change where snapshots have them.
    """
    return _emitted(seen, candidates, frames, gap_frame).select(*K, "kind", "source", "destination")


def event_table(seen: DataFrame, candidates: DataFrame, frames: DataFrame | None = None, gap_frame: int = 0) -> DataFrame:
    """(K, event_id, kind, source, destination, censored): events numbered in the order in which they come to be known.

    Births and gaps by current cage come first in a frame, then changes, splits, merges and
    the deaths it makes known. Births in a group's first frame are censored.
    """
    rows = _emitted(seen, candidates, frames, gap_frame)
    ends = _ends(frames if frames is not None else seen)
    within = F.row_number().over(Window.partitionBy("group_key", "known").orderBy("stage", "place", "turn"))
    before = Window.partitionBy("group_key").orderBy("known").rowsBetween(Window.unboundedPreceding, -1)
    skip = rows.groupBy("group_key", "known").agg(F.count("*").alias("n")).select("group_key", "known", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    rows = rows.withColumn("k", within).join(skip, ["group_key", "known"]).join(ends, "group_key")
    first = (F.col("kind") == "birth") & (F.col("frame_index") == F.col("begin"))
    return rows.select(*K, F.concat(F.lit("e"), F.col("skip") + F.col("k")).alias("event_id"), "kind", "source", "destination", first.alias("censored"))


def _emitted(seen: DataFrame, candidates: DataFrame, frames: DataFrame | None, gap_frame: int) -> DataFrame:
    """Events with known, the frame that makes them known, and (stage, place, turn), their order there."""
    seen = seen if "rank" in seen.columns else seen.withColumn("rank", F.row_number().over(Window.partitionBy(*K).orderBy("waters", "cage_type", "cage_id")))
    seen = seen if "gap" in seen.columns else seen.withColumn("gap", F.lit(0))
    candidates = candidates if "gap" in candidates.columns else candidates.withColumn("gap", F.lit(0))
    number = lambda c: F.substring(c, 2, 18).cast("long")
    own = Window.partitionBy("group_key", "track").orderBy("frame_index")
    phases = F.array_sort("phases") if "phases" in seen.columns else F.array().cast("array<string>")
    steps = seen.select(*K, "track", "rank", "cage_type", "gap", phases.alias("phases"), F.lag("frame_index").over(own).alias("before"), F.lag("cage_type").over(own).alias("was"), F.lag(phases).over(own).alias("had"), F.lead("frame_index").over(own).alias("next"))
    steps = steps.join(_ends(frames if frames is not None else seen), "group_key")
    none, here = F.lit(""), F.col("track")

    def rows(df: DataFrame, kind: str, stage: int, source: Column, destination: Column, known: Column | None = None, place: Column | None = None, turn: int = 0, at: Column | None = None) -> DataFrame:
        return df.select(
            "group_key", (F.col("frame_index") if at is None else at).cast("int").alias("frame_index"), F.lit(kind).alias("kind"), source.alias("source"), destination.alias("destination"),
            (F.col("frame_index") if known is None else known).alias("known"), F.lit(stage).alias("stage"), (F.col("rank").cast("long") if place is None else place).alias("place"), F.lit(turn).alias("turn"),
        )

    out = rows(steps.where("before IS NULL"), "birth", 0, none, here)
    out = out.unionByName(rows(steps.where("frame_index - before > 1"), "gap", 0, here, here, turn=1))
    out = out.unionByName(rows(steps.where("cage_type <> was"), "type_change", 1, here, here))
    out = out.unionByName(rows(steps.where("before IS NOT NULL AND phases <> had"), "phase_change", 1, here, here, turn=1))
    gone = steps.where((F.col("next").isNull()) & (F.col("end") - F.col("frame_index") > gap_frame))
    # cages of the last frame come before dormant tracks, which go by number
    place = F.col("rank").cast("long") if not gap_frame else number("track")
    out = out.unionByName(rows(gone, "death", 4, here, none, known=F.col("frame_index") + 1 + gap_frame, place=place, at=F.col("frame_index") + 1))
    now = seen.select(*K, F.col("cage_id").alias("after"), F.col("track").alias("to"), F.col("rank").alias("to_rank"))
    old = seen.select("group_key", F.col("frame_index").alias("from_frame"), F.col("cage_id").alias("before"), F.col("track").alias("from"), F.col("rank").alias("from_rank"))
    both = candidates.withColumn("from_frame", F.col("frame_index") - 1 - F.col("gap")).join(now, [*K, "after"]).join(old, ["group_key", "from_frame", "before"])
    both = both.withColumn("from_place", F.when(F.col("gap") == 0, F.col("from_rank").cast("long")).otherwise(F.lit(1 << 40) + number("from")))
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " ")
    split = both.groupBy(*K, F.col("from").alias("source"), "from_place").agg(F.countDistinct("to").alias("n"), text("to").alias("destination")).where("n > 1")
    merge = both.groupBy(*K, F.col("to").alias("destination"), "to_rank").agg(F.countDistinct("from").alias("n"), text("from").alias("source")).where("n > 1")
    out = out.unionByName(rows(split, "split", 2, F.col("source"), F.col("destination"), place=F.col("from_place")))
    return out.unionByName(rows(merge, "merge", 3, F.col("source"), F.col("destination"), place=F.col("to_rank").cast("long")))


def lifetimes(seen: DataFrame, frames: DataFrame | None = None, gap_frame: int = 0) -> DataFrame:
    """One row for each track: span, observed frames, lifetime up to the first frame without it, censoring.

    A track is right-censored if at most gap_frame frames follow its last one.
    """
    stamps = frame_table(seen if frames is None else frames).withColumnRenamed("time_ps", "end_time")
    rows = seen.groupBy("group_key", "track").agg(
        F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.min("time_ps").alias("first_time"), F.max("time_ps").alias("last_time"), F.count("*").alias("observed"),
        F.min_by("cage_type", "frame_index").alias("initial_type"), F.max_by("cage_type", "frame_index").alias("final_type"),
    ).join(_ends(stamps), "group_key")
    open_ = F.col("end") - F.col("last_frame") <= gap_frame
    death = stamps.select("group_key", (F.col("frame_index") - 1).alias("last_frame"), "end_time")
    rows = rows.join(death, ["group_key", "last_frame"], "left").withColumn("end_time", F.when(~open_, F.col("end_time")))
    return rows.select(
        "group_key", "track", "first_frame", "last_frame", "observed", (F.col("last_frame") - F.col("first_frame") + 1).cast("long").alias("span"),
        (F.coalesce("end_time", "last_time") - F.col("first_time")).alias("lifetime"), (F.col("first_frame") == F.col("begin")).alias("left_censored"), open_.alias("right_censored"), "initial_type", "final_type",
    )


def track_table(seen: DataFrame, frames: DataFrame | None = None, gap_frame: int = 0) -> DataFrame:
    """lifetimes with gap_frames, duration_status, and all types and phases of the track in order of their first frame."""
    phases = F.col("phases") if "phases" in seen.columns else F.array().cast("array<string>")
    kept = seen.select("group_key", "track", "frame_index", "cage_type", phases.alias("phases"))

    def listed(rows: DataFrame, value: str, name: str) -> DataFrame:
        first = rows.groupBy("group_key", "track", value).agg(F.min("frame_index").alias("f"))
        return first.groupBy("group_key", "track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", value))), lambda x: x[value]), ",").alias(name))

    types = listed(kept, "cage_type", "cage_types")
    labels = listed(kept.withColumn("phase", F.explode("phases")), "phase", "phases")
    lives = lifetimes(seen, frames, gap_frame)
    status = F.when(F.col("lifetime").isNull(), "time_unavailable").when(F.col("left_censored") & F.col("right_censored"), "left_and_right_censored_lower_bound").when(F.col("left_censored"), "left_censored_lower_bound").when(F.col("right_censored"), "right_censored_lower_bound").otherwise("complete")
    rows = lives.join(types, ["group_key", "track"]).join(labels, ["group_key", "track"], "left")
    return rows.withColumn("phases", F.coalesce("phases", F.lit(""))).withColumn("gap_frames", F.col("span") - F.col("observed")).withColumn("duration_status", status)


def lifetime_distribution(lives: DataFrame) -> DataFrame:
    """(group_key, lifetime, span, tracks, fraction, cumulative, survival, uncensored): shares by lifetime, null last."""
    rows = lives.groupBy("group_key", "lifetime", "span").agg(F.count("*").alias("tracks"), F.count_if(~F.col("left_censored") & ~F.col("right_censored")).alias("uncensored"))
    order = Window.partitionBy("group_key").orderBy(F.asc_nulls_last("lifetime"), F.asc_nulls_last("span"))
    whole, upto = F.sum("tracks").over(Window.partitionBy("group_key")), F.sum("tracks").over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.sum("tracks").over(Window.partitionBy("group_key").orderBy(F.asc_nulls_last("lifetime")).rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return rows.select("group_key", "lifetime", "span", "tracks", (F.col("tracks") / whole).alias("fraction"), (upto / whole).alias("cumulative"), (after / whole).alias("survival"), "uncensored")


def population(seen: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(K, scope, name, n): cages of each frame, in all, by type, and by phase label where there are any; frames without a cage have a total of 0."""
    rows = seen.groupingSets([[*map(F.col, K)], [*map(F.col, K), F.col("cage_type")]], *K, "cage_type").agg(F.count("*").alias("n"))
    out = rows.select(*K, F.when(F.col("cage_type").isNull(), "total").otherwise("cage_type").alias("scope"), F.coalesce("cage_type", F.lit("all")).alias("name"), "n")
    if "phases" in seen.columns:
        labels = seen.select(*K, F.explode("phases").alias("name")).groupBy(*K, "name").agg(F.count("*").alias("n"))
        out = out.unionByName(labels.select(*K, F.lit("phase").alias("scope"), "name", "n"))
    if frames is not None:
        empty = frames.select(*K).distinct().join(seen.select(*K).distinct(), K, "left_anti")
        out = out.unionByName(empty.select(*K, F.lit("total").alias("scope"), F.lit("all").alias("name"), F.lit(0).cast("long").alias("n")))
    return out


def guest_residence(seen: DataFrame, guests: DataFrame, lives: DataFrame | None = None) -> DataFrame:
    """(group_key, track, guest, episode, start_frame, end_frame, observed, residence): stays of guests(K, cage_id, guest) without a break.

    With lives, of lifetimes, also left_censored and right_censored: stays that begin or end with a censored track.
    """
    held = seen.select(*K, "time_ps", "track", "cage_id").join(guests, [*K, "cage_id"])
    own = Window.partitionBy("group_key", "track", "guest").orderBy("frame_index")
    islands = held.withColumn("island", F.col("frame_index") - F.row_number().over(own))
    rows = islands.groupBy("group_key", "track", "guest", "island").agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.count("*").alias("observed"), (F.max("time_ps") - F.min("time_ps")).alias("residence"))
    episode = F.row_number().over(Window.partitionBy("group_key", "track", "guest").orderBy("start_frame"))
    out = rows.select("group_key", "track", "guest", episode.cast("long").alias("episode"), "start_frame", "end_frame", "observed", "residence")
    if lives is None:
        return out
    ends = lives.select("group_key", "track", "first_frame", "last_frame", F.col("left_censored").alias("l"), F.col("right_censored").alias("r"))
    left, right = F.col("l") & (F.col("start_frame") == F.col("first_frame")), F.col("r") & (F.col("end_frame") == F.col("last_frame"))
    return out.join(ends, ["group_key", "track"]).select(*out.columns, left.alias("left_censored"), right.alias("right_censored"))
