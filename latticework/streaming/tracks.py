"""Tracking of live snapshots: one state for each group, kept between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from latticework.operators.tracking import Tracker, TrackingConfig

OUT = "group_key string, frame_index int, time_ps double, track string, cage_id string, cage_type string"


def dump(tracker: Tracker) -> str:
    live = [(n, frame, sorted(waters), more) for n, (frame, waters, more) in sorted(tracker.live.items())]
    return json.dumps({"config": asdict(tracker.config), "count": tracker.count, "live": live})


def load(text: str) -> Tracker:
    state = json.loads(text)
    tracker = Tracker(TrackingConfig(**state["config"]))
    tracker.count = state["count"]
    tracker.live = {n: (frame, frozenset(waters), more) for n, frame, waters, more in state["live"]}
    return tracker


def track_stream(snapshots: DataFrame, config: TrackingConfig | None = None) -> DataFrame:
    """Observations of a stream of (group_key, frame_index, time_ps, cage_id, cage_type, waters).

    Frames must arrive whole and in order; a frame that is not after the last one is an
    error. The state holds live and dormant tracks only, so it doesn't grow with time.
    """
    config = config or TrackingConfig()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, tracker = (state.get[0], load(state.get[1])) if state.exists else (-1, Tracker(config))
        rows = pd.concat(list(batches))
        out = []
        for frame, cages in rows.groupby("frame_index", sort=True):
            if frame <= last:
                raise ValueError(f"frame {frame} of group {key[0]} comes after frame {last}")
            states = [(r.cage_id, r.cage_type, tuple(sorted(int(w) for w in r.waters))) for r in cages.itertuples()]
            out += [(key[0], int(frame), float(cages["time_ps"].iloc[0]), f"t{n}", c, kind) for n, (c, kind, _) in tracker.step(int(frame), states)]
            last = int(frame)
        state.update((last, dump(tracker)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return snapshots.groupBy("group_key").applyInPandasWithState(step, OUT, "last int, tracker string", "append", GroupStateTimeout.NoTimeout)
