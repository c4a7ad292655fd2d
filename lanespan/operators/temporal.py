"""Temporal state over ordered frames: scene resets, smoothing, voting.

Frames carry ``group, frame_idx, height, width, p_height, p_width, thumb, p``; ``frame_idx`` (or
another column named by ``pos``) counts frames consecutively within a source from any number on, see
:func:`consecutive`; a gap is an error. A source is cut into blocks, and each block sees enough frames of the block
before it, so sources of any length spread over tasks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanespan.functions.ordered import block_of, running_total, with_halo, with_position
from lanespan.functions.scan import block_entries
from lanespan.operators.components import hysteresis
from lanespan.operators.runs import checked_map, pixels_to_runs
from lanespan.session import materialize

SOURCE = ("group",)
# Frames per block where whole maps are held together in memory.
MAP_BLOCK = 64
_SHAPE = ("height", "width", "p_height", "p_width")


def old_share(alpha: float) -> float:
    """Weight of the value before, beside ``alpha``, in the decimal digits of ``alpha``: 0.3 beside 0.7, where ``1 - 0.7`` is 0.30000000000000004."""
    return float(1 - Decimal(repr(float(alpha))))


def consecutive(frames: DataFrame, name: str = "pos") -> DataFrame:
    """Number the frames of each source without gaps, for sources whose indices have gaps."""
    return with_position(frames, SOURCE, ["frame_idx"], block_of("frame_idx"), name)


def _resets(window: Window, pos: str, threshold: float) -> Column:
    """True at the first frame, on a change of shape, or when the thumbnail moved too far."""
    if not 0 < threshold <= 1:
        raise ValueError("scene threshold must lie in (0, 1]")
    before = F.lag(pos).over(window)
    gap = F.raise_error(F.concat(F.lit("frame numbers have a gap before "), F.col(pos))).cast("boolean")
    first = F.when(before.isNull(), True).when(F.col(pos) - before != 1, gap).otherwise(False)
    previous = F.lag("thumb").over(window)
    change = F.zip_with("thumb", previous, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    mean = F.aggregate(change, F.lit(0.0), lambda s, v: s + v) / F.size("thumb")
    reshaped = F.lit(False)
    for name in _SHAPE:
        reshaped = reshaped | (F.col(name) != F.lag(name).over(window))
    return F.coalesce(first | reshaped | (mean > threshold), F.lit(False))


def scene_segments(frames: DataFrame, threshold: float = 0.25, pos: str = "frame_idx") -> DataFrame:
    """Reset flag and running segment number of every frame. Reads thumbnails, not maps."""
    columns = list(dict.fromkeys([*SOURCE, "frame_idx", pos, *_SHAPE, "thumb"]))
    spread, w, home = with_halo(frames.select(*columns), SOURCE, pos, 1)
    flagged = spread.withColumn("was_reset", _resets(w, pos, threshold)).filter(home)
    numbered = flagged.withColumn("_one", F.col("was_reset").cast("int"))
    total = running_total(numbered, SOURCE, pos, {"segment": "_one"}, size=None)
    return total.select(*SOURCE, "frame_idx", "was_reset", "segment")


def smooth(
    frames: DataFrame,
    alpha: float = 0.70,
    scene_threshold: float = 0.25,
    pos: str = "frame_idx",
    block: int = MAP_BLOCK,
) -> DataFrame:
    """Exponential smoothing of ``p`` per pixel, restarted at every scene reset.

    The recurrence is linear, so a block acts on the map before it as "weigh by a factor and add a map": the map is the
    block's own fold from zero, the factor is zero after a reset. A tree over the blocks finds the map each block starts
    from, but for the last bits: it adds in another order. So every block is folded from there, and those that started from another
    map than the block before ends with are folded again from that, until none is left. The result is the one of a single
    run, bit by bit. Old differences fade, so few blocks need a second time unless ``alpha`` is very small.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    rest = old_share(alpha)
    checked = frames.withColumn("p", checked_map("p", "p_height", "p_width"))
    spread, w, home = with_halo(checked, SOURCE, pos, 1, block)
    flagged = spread.select(
        "_block",
        *SOURCE,
        F.col(pos).cast("long").alias("_pos"),
        "frame_idx",
        *_SHAPE,
        _resets(w, pos, scene_threshold).alias("was_reset"),
        "p",
        home.alias("_home"),
    ).filter("_home")
    row = F.struct("_pos", "was_reset", "frame_idx", *_SHAPE, "p")
    rows = materialize(flagged.groupBy(*SOURCE, "_block").agg(F.sort_array(F.collect_list(row)).alias("_rows")))
    none = F.lit(None).cast("array<double>")

    def mixed(r: Column, last: Column) -> Column:
        weighed = F.zip_with(r["p"], last, lambda now, before: alpha * now + rest * before)
        from_zero = F.transform(r["p"], lambda now: alpha * now)
        return F.when(r["was_reset"], r["p"]).when(last.isNull(), from_zero).otherwise(weighed)

    def end(state: Column, r: Column) -> Column:
        factor = F.when(r["was_reset"], F.lit(0.0)).otherwise(state["factor"] * rest)
        return F.struct(mixed(r, state["map"]).alias("map"), factor.alias("factor"))

    begin = F.struct(none.alias("map"), F.lit(1.0).alias("factor"))
    effects = rows.select(*SOURCE, "_block", F.aggregate("_rows", begin, end).alias("_element"))

    def apply(effect: Column, last: Column) -> Column:
        added = F.zip_with(effect["map"], last, lambda own, before: own + effect["factor"] * before)
        # After a reset the maps may differ in size, and nothing of the earlier one is left.
        return F.when(last.isNotNull() & (effect["factor"] != 0), added).otherwise(effect["map"])

    def compose(first: Column, then: Column) -> Column:
        return F.struct(apply(then, first["map"]).alias("map"), (first["factor"] * then["factor"]).alias("factor"))

    guessed = block_entries(effects, SOURCE, compose, apply, none, "array<double>").withColumnRenamed("_entry", "_last")
    last_map = F.aggregate("_rows", F.col("_last"), lambda last, r: mixed(r, last))
    entered = _settled(rows, guessed, last_map)
    done = F.array().cast(
        "array<struct<frame_idx:bigint,height:int,width:int,p_height:int,p_width:int,was_reset:boolean,p:array<double>>>"
    )

    def collect(state: Column, r: Column) -> Column:
        last = mixed(r, state["last"])
        out = F.struct(
            r["frame_idx"].cast("long").alias("frame_idx"),
            *[r[n].cast("int").alias(n) for n in _SHAPE],
            r["was_reset"].alias("was_reset"),
            last.alias("p"),
        )
        return F.struct(last.alias("last"), F.concat(state["out"], F.array(out)).alias("out"))

    folded = rows.join(entered, [*SOURCE, "_block"], "left").select(
        *SOURCE,
        F.aggregate("_rows", F.struct(F.col("_last").alias("last"), done.alias("out")), collect, lambda state: state["out"]).alias("_out"),
    )
    # explode_outer keeps the optimizer from repeating the fold in a filter below.
    each = folded.select(*SOURCE, F.explode_outer("_out").alias("_o")).filter(F.col("_o").isNotNull())
    return each.select(*SOURCE, "_o.*")


def _settled(rows: DataFrame, guessed: DataFrame, last_map: Column) -> DataFrame:
    """``_last``, the map each block starts from, such that it is the one the block before ends with.

    ``last_map`` is the map a block of ``rows`` ends with. A source's first block starts from nothing and is right, so every
    round settles one more block at least.
    """
    unit = [*SOURCE, "_block"]
    entered, changed = materialize(guessed), rows
    while True:
        ends = changed.join(entered, unit).select(*SOURCE, (F.col("_block") + 1).alias("_block"), last_map.alias("_end"))
        wrong = materialize(
            entered.join(ends, unit).filter(~F.col("_end").eqNullSafe(F.col("_last"))).select(*unit, F.col("_end").alias("_last"))
        )
        if wrong.isEmpty():
            return entered
        units = wrong.select(*unit)
        entered = materialize(entered.join(units, unit, "left_anti").unionByName(wrong))
        changed = rows.join(units, unit, "left_semi")


def vote(
    frames: DataFrame,
    threshold: float = 0.55,
    window: int = 5,
    confirmed: int = 4,
    scene_threshold: float = 0.25,
    pos: str = "frame_idx",
    block: int = MAP_BLOCK,
) -> DataFrame:
    """Pixel is on when on now and in at least ``confirmed`` of the last ``window`` frames
    since the scene began. Returns the map of 0/1 as ``p``."""
    if not 1 <= confirmed <= window:
        raise ValueError("votes needed must lie between one and the window")
    frames = frames.withColumn("p", checked_map("p", "p_height", "p_width"))
    on = F.transform("p", lambda v: F.when(v >= threshold, 1).otherwise(0))
    size = max(block, window)
    spread, w, home = with_halo(frames, SOURCE, pos, window, size)
    flagged = spread.withColumns({"was_reset": _resets(w, pos, scene_threshold), "_on": on})
    numbered = flagged.withColumn(
        "_scene", F.sum(F.col("was_reset").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    recent = F.collect_list(F.struct("_scene", "_on")).over(w.rowsBetween(1 - window, 0))
    held = numbered.withColumn("_recent", recent).filter(home)
    same = F.filter("_recent", lambda r: r["_scene"] == F.col("_scene"))
    zeros = F.transform("_on", lambda v: F.lit(0))
    votes = F.aggregate(same, zeros, lambda s, r: F.zip_with(s, r["_on"], lambda a, b: a + b))
    voted = F.zip_with("_on", votes, lambda now, n: F.when((now == 1) & (n >= confirmed), 1.0).otherwise(0.0))
    return held.select(*SOURCE, "frame_idx", *_SHAPE, "was_reset", voted.alias("p"))


def temporal_filter(
    frames: DataFrame,
    mode: str = "ema",
    alpha: float = 0.70,
    low: float = 0.40,
    high: float = 0.65,
    threshold: float = 0.55,
    window: int = 5,
    confirmed: int = 4,
    scene_threshold: float = 0.25,
    pos: str = "frame_idx",
) -> DataFrame:
    """Road spans per frame after the temporal rule; ``none`` still applies the hysteresis."""
    def sized(maps: DataFrame) -> DataFrame:
        return maps.withColumns({"height": F.col("p_height"), "width": F.col("p_width")})

    if mode == "legacy":
        voted = vote(frames, threshold, window, confirmed, scene_threshold, pos)
        return pixels_to_runs(sized(voted), 0.5).drop("peak")
    if mode == "ema":
        return hysteresis(sized(smooth(frames, alpha, scene_threshold, pos)), low, high)
    if mode == "none":
        return hysteresis(sized(frames), low, high)
    raise ValueError("mode must be ema, legacy or none")
