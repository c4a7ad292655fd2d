"""Temporal rule on a live stream: state per source and run.

Sources are dealt into lanes by a hash, and a lane is one call per micro-batch: a call costs milliseconds, whatever it does, and there
may be a million sources. State is a map with an entry per source and run (last frame, its sizes and thumbnail, the maps carried on), and a second
one for what exceeds a chunk, so that no state row grows with a map; entries of an idle run expire by themselves. A lane's part of
a micro-batch is a stack of maps. Its scenes are found at once from the stacked thumbnails; smoothing goes down all scenes
together, frame by frame, and votes are differences of running counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lanespan.operators.components import hysteresis
from lanespan.operators.runs import checked_map, pixels_to_runs
from lanespan.operators.temporal import old_share

OUTPUT = "group string, run_id string, frame_idx bigint, p_height int, p_width int, was_reset boolean, p array<double>"
SOURCE = "group string, run_id string"
LAST = "frame_idx bigint, shape array<int>, thumb binary, rows int, parts int, part binary"
CHUNK = "part binary"
MODES = ("ema", "legacy", "none")
SIZES = ("height", "width", "p_height", "p_width")
#: Bytes of a carried map in one state row.
CHUNK_BYTES = 1 << 20
#: Lanes of sources. A checkpoint keeps the number it began with.
LANES = 1024
#: State with several variables, and state that expires, is kept by this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _scene_starts(shapes: np.ndarray, thumbs: list[np.ndarray], first: np.ndarray, before: list[tuple | None], limit: float) -> np.ndarray:
    """Which frames begin a scene; ``before`` has shape and thumbnail of the frame ahead of each source's ``first``, if any."""
    ahead_shapes, ahead = np.vstack([shapes[:1], shapes[:-1]]), [thumbs[0], *thumbs[:-1]]
    for i, known in zip(first, before, strict=True):
        ahead_shapes[i], ahead[i] = known if known else (-1, thumbs[i])
    starts = (shapes != ahead_shapes).any(axis=1)
    same = np.flatnonzero(~starts)
    for length in np.unique(shapes[same, -1]):
        at = same[shapes[same, -1] == length]
        moved = _stacked([thumbs[i] for i in at], length) - _stacked([ahead[i] for i in at], length)
        starts[at] = np.abs(moved).mean(axis=1) > limit
    return starts


def _stacked(rows: list[np.ndarray], length: int) -> np.ndarray:
    return np.concatenate(rows).reshape(len(rows), length)


def _smoothed(maps: np.ndarray, carried: np.ndarray, alpha: float, begins: np.ndarray | None = None) -> np.ndarray:
    """Running mixture down the scenes; ``carried`` has the last mixture before the first one, or no row.

    ``begins`` has the places, in ``maps`` behind ``carried``, where scenes begin; without it there is one.
    """
    rest = old_share(alpha)
    stack = np.vstack([carried, maps]) if len(carried) else maps
    begins = np.zeros(1, int) if begins is None else begins
    fresh = alpha * stack
    fresh[begins] = stack[begins]
    lengths = np.diff(np.r_[begins, len(stack)])
    longest = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[longest], lengths[longest]
    for i in range(1, lengths[0]):
        at = begins[: np.searchsorted(-lengths, -i)] + i
        fresh[at] += rest * fresh[at - 1]
    return fresh[len(carried) :]


def _voted(on: np.ndarray, begins: np.ndarray, window: int, confirmed: int) -> np.ndarray:
    """Pixels on now and often enough in the window; ``begins`` has the places where scenes begin."""
    total = np.vstack([np.zeros((1, on.shape[1])), np.cumsum(on, axis=0)])
    after = np.arange(len(on)) + 1
    lengths = np.diff(np.r_[begins, len(on)])
    recent = total[after] - total[np.maximum(np.repeat(begins, lengths), after - window)]
    return on * (recent >= confirmed)


@dataclass
class Rule:
    """What happens to the frames of a scene."""

    mode: str
    alpha: float
    threshold: float
    window: int
    confirmed: int
    scene_threshold: float

    def scenes(self, stack: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Results of a stack of scenes, the rows that may be carried on, and how many of a scene's last ones are.

        What was carried on is part of the stack, ahead of a scene's frames.
        """
        if self.mode == "none":
            return stack, stack, 0
        if self.mode == "ema":
            out = _smoothed(stack, stack[:0], self.alpha, begins)
            return out, out, 1
        on = (stack >= self.threshold).astype(np.float64)
        return _voted(on, begins, self.window, self.confirmed), on, self.window


class TemporalFilter(StatefulProcessor):
    """State of a lane's sources and runs; ``wait`` is the time in milliseconds after which an idle run is forgotten, ``chunk`` the bytes of a state row."""

    def __init__(self, rule: Rule, wait: int | None, chunk: int):
        self.rule, self.wait, self.chunk = rule, wait, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", SOURCE, LAST, self.wait)
        self.maps = handle.getMapState("maps", f"{SOURCE}, part int", CHUNK, self.wait)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows), ignore_index=True)
        source = frames.groupby(["group", "run_id"], dropna=False, sort=False).ngroup().to_numpy()
        order = np.lexsort((frames["frame_idx"].to_numpy(), source))
        frames, source = frames.iloc[order].reset_index(drop=True), source[order]
        first = np.flatnonzero(np.diff(source, prepend=-1))
        names = list(zip(frames["group"].iloc[first], frames["run_id"].iloc[first], strict=True))
        numbers = frames["frame_idx"].to_numpy()
        known = [self._restored(name, int(numbers[i])) for name, i in zip(names, first, strict=True)]
        thumbs = [np.asarray(t, float) for t in frames["thumb"]]
        maps = [np.asarray(p, float) for p in frames["p"]]
        shapes = np.c_[frames[list(SIZES)].to_numpy(), [len(t) for t in thumbs]]
        starts = _scene_starts(shapes, thumbs, first, [k and k[:2] for k in known], self.rule.scene_threshold)
        carried = {i: k[2] for i, k in zip(first, known, strict=True) if k and not starts[i]}
        results, left = self._filtered(maps, np.union1d(first, np.flatnonzero(starts)), carried)
        for name, k, i in zip(names, known, np.r_[first[1:], len(frames)] - 1, strict=True):
            self._keep(name, int(numbers[i]), shapes[i], thumbs[i], left[i], k[3] if k else 0)
        columns = ["group", "run_id", "frame_idx", "p_height", "p_width"]
        yield frames[columns].assign(was_reset=starts, p=results)

    def _filtered(self, maps: list[np.ndarray], edges: np.ndarray, carried: dict) -> tuple[list[np.ndarray], dict]:
        """Results of all frames, and by the last frame of each scene the rows to carry on; scenes begin at ``edges``."""
        ends = np.r_[edges[1:], len(maps)]
        lengths = np.array([len(maps[a]) for a in edges])
        results, left = [None] * len(maps), {}
        for length in np.unique(lengths):
            rows, begins, spans = [], [], []
            for a, b in zip(edges[lengths == length], ends[lengths == length], strict=True):
                begins.append(len(rows))
                rows += [*carried.get(a, ()), *maps[a:b]]
                spans.append((a, b, len(rows)))
            out, held, count = self.rule.scenes(_stacked(rows, length), np.array(begins))
            for begin, (a, b, end) in zip(begins, spans, strict=True):
                results[a:b] = out[end - (b - a) : end]
                left[b - 1] = held[max(begin, end - count) : end]
        return results, left

    def close(self) -> None:
        pass

    def _restored(self, name: tuple, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
        """Sizes and thumbnail of the frame before, the maps carried on, and their state rows."""
        state = self.last.getValue(name)
        if state is None:
            return None
        last, shape, thumb, count, parts, part = state
        if first <= last:
            raise ValueError(f"frame {first} of {name[0]} came after frame {last}")
        whole = b"".join([bytes(part), *(bytes(self.maps.getValue((*name, n))[0]) for n in range(1, parts))])
        return np.array(shape), np.frombuffer(bytes(thumb)), np.frombuffer(whole).reshape(count, -1) if count else np.empty((0, 0)), parts

    def _keep(self, name: tuple, frame: int, shape: np.ndarray, thumb: np.ndarray, carried: np.ndarray, parts: int) -> None:
        whole = carried.tobytes()
        chunks = [whole[at : at + self.chunk] for at in range(0, len(whole), self.chunk)] or [b""]
        self.last.updateValue(name, (frame, shape.tolist(), thumb.tobytes(), len(carried), len(chunks), chunks[0]))
        for n, part in enumerate(chunks[1:], 1):
            self.maps.updateValue((*name, n), (part,))
        for n in range(len(chunks), parts):
            self.maps.removeKey((*name, n))


def filter_stream(
    frames: DataFrame,
    mode: str = "ema",
    alpha: float = 0.70,
    threshold: float = 0.55,
    window: int = 5,
    confirmed: int = 4,
    scene_threshold: float = 0.25,
    idle: str | None = None,
    lanes: int = LANES,
) -> DataFrame:
    """Smooth or vote frames of a stream in frame order; a new ``run_id`` starts clean, and runs of a source may alternate.

    Input columns: ``group, run_id, frame_idx, height, width, p_height, p_width, thumb, p``. Frames of a run have to arrive
    in order, by micro-batches at least; a step back is an error, as is a bad map. With ``idle`` (such as "1 hour") the state of a run without
    frames for so long is dropped; such a query never ends by itself, as it has to keep looking at the clock. The session's state
    store becomes RocksDB; a checkpoint keeps the store it began with. Sources share ``lanes`` by a hash: a lane's part of a micro-batch is
    held in one task, and no more tasks than lanes have work.
    """
    if mode not in MODES:
        raise ValueError("mode must be ema, legacy or none")
    if not 0 < alpha <= 1 or not 0 < scene_threshold <= 1 or not 0 <= threshold <= 1:
        raise ValueError("alpha, scene threshold and threshold are shares")
    if not 1 <= confirmed <= window:
        raise ValueError("votes needed must lie between one and the window")
    if lanes < 1:
        raise ValueError("there has to be a lane")
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    checked = frames.withColumn("p", checked_map("p", "p_height", "p_width"))
    rule = Rule(mode, alpha, threshold, window, confirmed, scene_threshold)
    dealt = checked.withColumn("lane", F.pmod(F.xxhash64("group", "run_id"), F.lit(lanes)))
    return dealt.groupBy("lane").transformWithStateInPandas(
        TemporalFilter(rule, wait, CHUNK_BYTES), OUTPUT, "Append", "ProcessingTime" if wait else "None"
    )


def road_spans(filtered: DataFrame, mode: str = "ema", low: float = 0.40, high: float = 0.65) -> DataFrame:
    """Road spans of frames that passed :func:`filter_stream`; works on a stream's micro-batch (``foreachBatch``) and on a table."""
    sized = filtered.select("group", "frame_idx", F.col("p_height").alias("height"), F.col("p_width").alias("width"), "p")
    return pixels_to_runs(sized, 0.5).drop("peak") if mode == "legacy" else hysteresis(sized, low, high)


def span_intake(filtered: DataFrame, path: str, checkpoint: str, mode: str = "ema", low: float = 0.40, high: float = 0.65):
    """Writer that turns each micro-batch of filtered frames into road spans; a repeated batch replaces its own files."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        road_spans(batch, mode, low, high).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return filtered.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
