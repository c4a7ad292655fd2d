"""Branch tracking on a live stream with the same step the batch job uses."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lanespan.operators.tracks import _FIELDS, _TRACK_FIELDS, TRACK, GeometryConfig, Route, Tracker

OUTPUT = f"group string, run_id string, frame_idx bigint, main_id bigint, {TRACK}"
#: What a frame brings, besides its source and run.
_FRAME = ("frame_idx", "height", "width", "reset", "dets")
STATE = "tracks string, next_id bigint, route string, shape array<int>"


def track_stream(observations: DataFrame, config: GeometryConfig = GeometryConfig(), idle_ms: int | None = None) -> DataFrame:
    """Track rows per frame from a stream of ``group, run_id, frame_idx, height, width, reset, dets``.

    With ``idle_ms`` the state of a run without frames for so long is dropped; such a query never ends by itself.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker, route, shape = Tracker(config), Route(), None
        if state.exists:
            tracks, next_id, followed, shape = state.get
            tracker = Tracker(config, json.loads(tracks), next_id)
            route, shape = Route(**json.loads(followed)), tuple(shape)
        # A source brings few frames at a time, so a table per source and frame would cost more than the tracking.
        out = []
        frames = (zip(*(batch[n].tolist() for n in _FRAME), strict=True) for batch in batches)
        for frame, height, width, reset, dets in sorted(itertools.chain.from_iterable(frames), key=lambda f: f[0]):
            if reset or shape != (height, width):
                tracker, route, shape = Tracker(config), Route(), (height, width)
            tracks = tracker.step([{n: _plain(d[n]) for n in _FIELDS} for d in dets], height, width)
            main = route.follow(tracks)
            out += [(frame, main, *(t[n] for n in _TRACK_FIELDS)) for t in tracks]
        state.update((json.dumps(tracker.tracks), tracker.next_id, json.dumps(vars(route)), list(shape)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        columns = dict(zip(["frame_idx", "main_id", *_TRACK_FIELDS], zip(*out), strict=True)) if out else {}
        if columns:
            columns["main_id"] = pd.array(columns["main_id"], dtype="Int64")
            yield pd.DataFrame({"group": key[0], "run_id": key[1], **columns})

    return observations.groupBy("group", "run_id").applyInPandasWithState(
        update, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    )


def _plain(value):
    return value.item() if hasattr(value, "item") else value
