import itertools
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest

from latticework.operators import select, tracking
from latticework.plans import tracks
from latticework.sources.adapters import snapshots
from latticework.streaming.tracks import dump, load, track_stream

SNAPSHOTS = "group_key string, frame_index int, time_ps double, cage_id string, cage_type string, waters array<long>"


def frames(spark, *steps):
    return spark.createDataFrame([("A", f, float(f), c, "512", sorted(w)) for f, cages in enumerate(steps) for c, w in cages.items()], SNAPSHOTS)


def test_best_matching_against_enumeration():
    rng = random.Random(1)
    for _ in range(300):
        left, right = [f"a{k}" for k in range(rng.randint(1, 5))], [f"b{k}" for k in range(rng.randint(1, 5))]
        w = {p: rng.choice([1.0, 2.5, 40.0, 70.0, 71.0]) for p in itertools.product(left, right) if rng.random() < 0.6}
        best = (0, 0.0)
        for n in range(min(len(left), len(right)) + 1):
            for a in itertools.permutations(left, n):
                for b in itertools.combinations(right, n):
                    if all(p in w for p in zip(a, b, strict=True)):
                        best = max(best, (n, sum(w[p] for p in zip(a, b, strict=True))))
        got = tracking.best_matching(w)
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        assert (len(got), sum(w[p] for p in got)) == pytest.approx(best)


def test_split_merge_and_death(spark):
    a, b = set(range(20)), set(range(100, 120))
    snaps = frames(spark, {"x": a, "y": b}, {"x": set(range(13)), "z": set(range(9, 20)), "y": b}, {"x": a})
    seen, candidates = tracking.track(snaps, tracking.TrackingConfig(min_jaccard=0.3))
    events = {(r.kind, r.frame_index, r.source, r.destination) for r in tracking.events(seen, candidates).collect()}
    assert {e for e in events if e[0] != "birth"} == {("split", 1, "t1", "t1 t3"), ("merge", 2, "t1 t3", "t1"), ("death", 2, "t2", ""), ("death", 2, "t3", "")}


def test_gap_bridges_a_missing_frame(spark):
    a = set(range(20))
    snaps = frames(spark, {"x": a}, {"other": set(range(50, 70))}, {"x": a})
    assert tracking.track(snaps)[0].select("track").distinct().count() == 3
    seen, _ = tracking.track(snaps, tracking.TrackingConfig(gap_frame=1))
    assert sorted((r.frame_index, r.track) for r in seen.collect()) == [(0, "t1"), (1, "t2"), (2, "t1")]


def test_fold_agrees_with_parallel_links(spark):
    rng = random.Random(2)
    steps, pools = [], {f"c{k}": set(rng.sample(range(500), 24)) for k in range(12)}
    for _ in range(15):
        for c in pools:
            pools[c] = set(rng.sample(sorted(pools[c]), 21)) | set(rng.sample(range(500), 3)) if rng.random() < 0.9 else set(rng.sample(range(500), 24))
        steps.append({c: w for c, w in pools.items() if rng.random() < 0.9})
    snaps = frames(spark, *steps)
    one = {(r.frame_index, r.cage_id): r.track for r in tracking.track(snaps)[0].collect()}
    tracker, two = tracking.Tracker(tracking.TrackingConfig()), {}
    for f, cages in enumerate(steps):
        tracker = load(dump(tracker))
        two |= {(f, c): f"t{n}" for n, (c, _, _) in tracker.step(f, [(c, "512", tuple(sorted(w))) for c, w in cages.items()])}
    assert one == two


def test_stream(spark, tmp_path):
    a = set(range(20))
    snaps = frames(spark, {"x": a, "y": {1, 2, 50, 51}}, {"x": a | {99}}, {"x": a})
    for f in range(3):
        snaps.where(f"frame_index = {f}").coalesce(1).write.parquet(str(tmp_path / "in" / f"f={f}"))
    source = spark.readStream.schema(SNAPSHOTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = track_stream(source).writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.frame_index, r.track, r.cage_id) for r in spark.table("tracks").collect())
    assert got == [(0, "t1", "x"), (0, "t2", "y"), (1, "t1", "x"), (2, "t1", "x")]


def test_order_and_sampling(spark):
    snaps = frames(spark, {"x": {1}}, {"x": {1}}, {"x": {1}}, {"x": {1}})
    assert tracking.check_order(snaps).count() == 0
    rows = snaps.select("group_key", "frame_index", "time_ps")
    assert [r.frame_index for r in select.sample_times(rows, 3.0).orderBy("frame_index").collect()] == [0, 3]
    for bad in (0.5, 1.5):
        with pytest.raises(ValueError):
            select.sample_times(rows, bad)
    with pytest.raises(ValueError):
        tracking.TrackingConfig(gap_frame=-1)


@pytest.fixture
def gapped(spark, tmp_path):
    """Events of two types over steps 0 to 9 without 4 to 6, so that frames 5 and 6 are missing; users come and go."""
    rng = random.Random(3)
    start = datetime(2024, 1, 1, 1, tzinfo=timezone.utc)
    rows = [(start + timedelta(hours=12 * s), u, c) for s in (0, 1, 2, 3, 7, 8, 9) for c, first in (("a", 1), ("b", 101)) for u in range(first, first + 30) if rng.random() < 0.75]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_member_residence_matches_brute_force(spark, gapped):
    track = {(r.frame_index, r.cage_id): r.track for r in tracks.track_observations(spark, gapped).collect()}
    frames_of = defaultdict(list)
    for r in snapshots(spark, gapped).orderBy("frame_index").collect():
        for guest in r.waters:
            frames_of[track[r.frame_index, r.cage_id], guest].append(r.frame_index)
    want = set()
    for (name, guest), held in frames_of.items():
        stays = [[held[0]]]
        for f in held[1:]:
            stays[-1].append(f) if f == stays[-1][-1] + 1 else stays.append([f])
        want |= {(name, guest, k, s[0], s[-1], len(s), 12.0 * (s[-1] - s[0])) for k, s in enumerate(stays, 1)}
    got = [tuple(r) for r in tracks.track_member_residence(spark, gapped).select("track", "guest", "episode", "start_frame", "end_frame", "observed", "residence").collect()]
    assert len(got) == len(want) and set(got) == want
    assert {g for _, g, *_ in got} == {g for _, g in frames_of} and any(e > 1 for _, _, e, *_ in got)


def test_order_of_all_snapshots_with_a_gap(spark, gapped):
    assert [tuple(r) for r in tracks.frame_order_all(spark, gapped).collect()] == [(7, "gap")]


def test_graph_mode(spark):
    make = lambda *n: spark.createDataFrame([([1] * k,) for k in n], "hydrogens array<int>")
    assert (select.graph_mode(make(2, 2)), select.graph_mode(make(0, 0))) == ("hbond", "oo")
    with pytest.raises(ValueError):
        select.graph_mode(make(0, 2))
