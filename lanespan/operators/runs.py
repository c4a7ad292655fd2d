"""Mask algebra on run-length tables.

A mask is a table ``(group, frame_idx, y, x0, x1)`` of half-open spans on image rows, next to
``mask_dims(group, frame_idx, height, width)``; a frame without road has dims but no spans.
Raw spans may overlap and repeat without limit. The first step of every operator counts or
reduces them per (row, x), combined before the shuffle, so afterwards a row holds at most as
many entries as it has pixels and a frame is bounded by its raster.

After that step whole frames are placed once with :func:`co_locate`; the windows and
aggregates that follow cluster on the frame plus more columns and reuse that placement, so a
chain of morphology costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanespan.functions.exprs import half_even, probability_fault

FRAME = ("group", "frame_idx")


def row_keys(frame: Sequence[str] = FRAME) -> list[str]:
    return [*frame, "y"]


def co_locate(runs: DataFrame, frame: Sequence[str] = FRAME, heavy: bool = False) -> DataFrame:
    """Bring each frame's spans to one partition; Spark drops the step where they already are.

    Spans are few bytes but morphology and labelling multiply the work per byte, so a ``heavy``
    chain keeps all shuffle partitions where size-based merging would leave cores idle.
    """
    if heavy:
        return runs.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *frame)
    return runs.repartition(*frame)


def with_dims(runs: DataFrame, dims: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """Spans with their frame size as ``_h`` and ``_w``."""
    sizes = dims.select(*frame, F.col("height").alias("_h"), F.col("width").cast("int").alias("_w"))
    return runs.join(sizes, list(frame))


# ---------------------------------------------------------------- pixels to spans


def checked_map(values: str = "p", height: str = "height", width: str = "width") -> Column:
    """The probabilities of a map, or an error where they are no map of that size."""
    fault = probability_fault(values, height, width)
    refuse = F.raise_error(F.concat(F.lit("bad probability map: "), fault)).cast("array<double>")
    return F.when(fault.isNull(), F.col(values).cast("array<double>")).otherwise(refuse)


def pixels_to_runs(
    maps: DataFrame, threshold: float, values: str = "p", keep: Sequence[str] = FRAME
) -> DataFrame:
    """Maximal row spans with ``value >= threshold``; ``peak`` is the largest value inside.

    Works inside each row of the table (no explode to pixels, no shuffle). A map of the wrong size, with a value that is not finite or
    outside [0, 1] is an error.
    """
    maps = maps.withColumn(values, checked_map(values))
    v, w = F.col(values), F.col("width")
    last = F.size(v) - 1

    def on(i: Column) -> Column:
        return F.get(v, i) >= threshold

    index = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(index, lambda i: on(i) & ((i % w == 0) | ~on(i - 1)))
    ends = F.filter(index, lambda i: on(i) & ((i % w == w - 1) | ~on(i + 1)))
    spans = maps.select(*keep, v.alias("_v"), w.alias("_w"), F.arrays_zip(starts.alias("s"), ends.alias("e")).alias("_z"))
    # explode_outer: a plain explode makes the optimizer copy the array expressions into a filter
    # below, where they would be evaluated again for every element.
    one = spans.select(*keep, "_v", "_w", F.explode_outer("_z").alias("_z")).filter(F.col("_z").isNotNull())
    s, e = F.col("_z.s"), F.col("_z.e")
    return one.select(
        *keep,
        F.floor(s / F.col("_w")).cast("int").alias("y"),
        (s % F.col("_w")).cast("int").alias("x0"),
        (e % F.col("_w") + 1).cast("int").alias("x1"),
        F.array_max(F.slice("_v", s + 1, e - s + 1)).cast("double").alias("peak"),
    )


# ---------------------------------------------------------------- union, overlay, complement


def _joined(starts: DataFrame, keys: Sequence[str], separate: Column | None = None) -> DataFrame:
    """Join overlapping and touching spans that have distinct starts within ``keys``."""
    w = Window.partitionBy(*keys).orderBy("x0")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    touching = reach >= F.col("x0")
    if separate is not None:
        touching = touching & ~separate
    marked = starts.withColumn("_new", F.when(touching, 0).otherwise(1))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = marked.withColumn("_island", island).groupBy(*keys, "_island")
    return merged.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_island")


def merge_runs(runs: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """Union of the spans on each row as disjoint, non-touching spans."""
    keys = row_keys(frame)
    widest = runs.filter(F.col("x1") > F.col("x0")).groupBy(*keys, "x0").agg(F.max("x1").alias("x1"))
    return _joined(co_locate(widest, frame), keys)


def overlay(layers: dict[str, DataFrame], frame: Sequence[str] = FRAME) -> DataFrame:
    """Cut every row at all span ends; a boolean per layer tells where it is present.

    Set operations on masks are filters on the result. Raw overlapping spans are fine.
    """
    tagged = None
    for name, runs in layers.items():
        part = runs.select(*row_keys(frame), "x0", "x1", F.lit(name).alias("layer"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return overlay_tagged(tagged, list(layers), frame)


def overlay_tagged(tagged: DataFrame, names: Sequence[str], frame: Sequence[str] = FRAME) -> DataFrame:
    """:func:`overlay` for spans that name their layer in the column ``layer``.

    Span ends are summed per (row, x) before the shuffle, so copies never travel.
    """
    keys = row_keys(frame)
    ends = F.explode(
        F.array(
            F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")),
            F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")),
        )
    )
    events = tagged.filter(F.col("x1") > F.col("x0")).select(*keys, "layer", ends.alias("_e"))
    summed = events.groupBy(*keys, F.col("_e.x").alias("x0")).agg(
        *[F.sum(F.when(F.col("layer") == n, F.col("_e.d")).otherwise(0)).alias(f"_{n}") for n in names]
    )
    w = Window.partitionBy(*keys).orderBy("x0")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cut = co_locate(summed, frame).select(
        *keys,
        "x0",
        F.lead("x0").over(w).alias("x1"),
        *[(F.sum(f"_{n}").over(upto) > 0).alias(n) for n in names],
    )
    anywhere = F.lit(False)
    for n in names:
        anywhere = anywhere | F.col(n)
    return cut.filter(F.col("x1").isNotNull() & anywhere)


def intersect_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    return overlay({"a": a, "b": b}).filter("a and b").drop("a", "b")


def subtract_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    return overlay({"a": a, "b": b}).filter("a and not b").drop("a", "b")


# ---------------------------------------------------------------- morphology
#
# Chains work on a canvas: the spans plus one empty border span ``[width, width)`` per image
# row, all with the frame size. The border makes rows without road visible, so background
# spans follow from a window alone, and the canvas never leaves its partition.

# Height, width and reach of a frame, on every row of its canvas.
SIZES = ("_h", "_w", "_r")


def to_canvas(runs: DataFrame, dims: DataFrame, frame: Sequence[str] = FRAME, reach: Column | int = 0) -> DataFrame:
    """Merged spans and row borders of every frame in ``dims``; ``reach`` is a length of each frame that kernels may use."""
    keys = row_keys(frame)
    size = [F.col("height").cast("int").alias("_h"), F.col("width").cast("int").alias("_w"), F.lit(reach).cast("int").alias("_r")]
    borders = dims.select(*frame, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), *size)
    unknown = F.lit(None).cast("int")
    spans = runs.select(*keys, "x0", "x1", *[unknown.alias(n) for n in SIZES])
    rows = spans.unionByName(
        borders.select(*keys, F.col("_w").alias("x0"), F.col("_w").alias("x1"), *SIZES)
    )
    whole = Window.partitionBy(*frame)
    sized = co_locate(rows, frame, heavy=True).withColumns({n: F.max(n).over(whole) for n in SIZES})
    return sized.filter(F.col("_h").isNotNull())


def _is_border() -> Column:
    return F.col("x0") == F.col("_w")


def _inside(canvas: DataFrame) -> DataFrame:
    return canvas.filter((F.col("y") >= 0) & (F.col("y") < F.col("_h")))


def from_canvas(canvas: DataFrame) -> DataFrame:
    return _inside(canvas).filter(~_is_border()).drop(*SIZES)


def _flip(canvas: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Exchange road and background inside the frame."""
    keys = row_keys(frame)
    before = F.coalesce(F.lag("x1").over(Window.partitionBy(*keys).orderBy("x0")), F.lit(0))
    border = F.struct(F.col("_w").alias("x0"), F.col("_w").alias("x1"))
    gap = F.struct(F.col("_gap").alias("x0"), F.col("x0").alias("x1"))
    open_gap = F.col("_gap") < F.col("x0")
    parts = (
        F.when(_is_border() & open_gap, F.array(gap, border))
        .when(_is_border(), F.array(border))
        .when(open_gap, F.array(gap))
    )
    flipped = _inside(canvas).withColumn("_gap", before).select(*keys, *SIZES, F.explode(parts).alias("_p"))
    return flipped.select(*keys, "_p.x0", "_p.x1", *SIZES)


def _grow(canvas: DataFrame, kernel: Sequence[tuple[int | Column, int | Column]], frame: Sequence[str]) -> DataFrame:
    """One dilation pass. Rows may leave the frame; a later pass can bring them back.

    Kernel rows may be columns of the frame's sizes; those with a null half width are not there.
    """
    keys = [*row_keys(frame), *SIZES]
    step = lambda dy, hw: F.struct(F.lit(dy).cast("int").alias("dy"), F.lit(hw).cast("int").alias("hw"))
    rows = F.array(*[step(*k) for k in kernel])
    if any(isinstance(hw, Column) for _, hw in kernel):
        rows = F.filter(rows, lambda k: k["hw"].isNotNull())
    steps = F.when(_is_border(), F.array(step(0, 0))).otherwise(rows)
    wide = canvas.withColumn("_k", F.explode(steps)).select(
        *frame,
        (F.col("y") + F.col("_k.dy")).cast("int").alias("y"),
        F.greatest(F.lit(0), F.col("x0") - F.col("_k.hw")).cast("int").alias("x0"),
        F.least(F.col("_w"), F.col("x1") + F.col("_k.hw")).cast("int").alias("x1"),
        *SIZES,
    )
    starts = wide.groupBy(*keys, "x0").agg(F.max("x1").alias("x1"))
    return _joined(starts, keys, separate=_is_border())


def _dilated(canvas: DataFrame, kernel, iterations: int, frame: Sequence[str]) -> DataFrame:
    for _ in range(iterations):
        canvas = _grow(canvas, kernel, frame)
    return canvas


def _eroded(canvas: DataFrame, kernel, iterations: int, frame: Sequence[str]) -> DataFrame:
    """Pixels outside the frame never remove anything: only background inside it grows."""
    return _flip(_dilated(_flip(canvas, frame), kernel, iterations, frame), frame)


def morphology(
    runs: DataFrame,
    dims: DataFrame,
    steps: Sequence[tuple[str, Sequence[tuple[int, int]], int]],
    frame: Sequence[str] = FRAME,
    reach: Column | int = 0,
) -> DataFrame:
    """Apply ``(dilate | erode, symmetric kernel, iterations)`` steps to merged spans."""
    apply = {"dilate": _dilated, "erode": _eroded}
    canvas = to_canvas(runs, dims, frame, reach)
    for name, kernel, iterations in steps:
        canvas = apply[name](canvas, kernel, iterations, frame)
    return from_canvas(canvas)


def complement_runs(runs: DataFrame, dims: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """Background spans inside the frame. ``runs`` must be merged."""
    return from_canvas(_flip(to_canvas(runs, dims, frame), frame))


def ellipse_kernel(size: int) -> list[tuple[int, int]]:
    """Rows ``(dy, half width)`` of the discrete ellipse with an odd diameter."""
    if size < 1 or size % 2 == 0:
        raise ValueError("kernel size must be odd")
    r = size // 2
    return [(dy, round(r * (1 - dy * dy / (r * r)) ** 0.5) if r else 0) for dy in range(-r, r + 1)]


def dilate_runs(runs: DataFrame, dims: DataFrame, kernel, iterations: int = 1) -> DataFrame:
    return morphology(runs, dims, [("dilate", kernel, iterations)])


def erode_runs(runs: DataFrame, dims: DataFrame, kernel, iterations: int = 1) -> DataFrame:
    return morphology(runs, dims, [("erode", kernel, iterations)])


def open_runs(runs: DataFrame, dims: DataFrame, kernel, iterations: int = 1) -> DataFrame:
    return morphology(runs, dims, [("erode", kernel, iterations), ("dilate", kernel, iterations)])


def close_runs(runs: DataFrame, dims: DataFrame, kernel, iterations: int = 1) -> DataFrame:
    return morphology(runs, dims, [("dilate", kernel, iterations), ("erode", kernel, iterations)])


def legacy_cleanup(runs: DataFrame, dims: DataFrame) -> DataFrame:
    """Open once, then close twice, with the 5-pixel ellipse."""
    kernel = ellipse_kernel(5)
    steps = [("erode", kernel, 1), ("dilate", kernel, 1), ("dilate", kernel, 2), ("erode", kernel, 2)]
    return morphology(runs, dims, steps)


def smooth_runs(runs: DataFrame, dims: DataFrame) -> DataFrame:
    """Close, then open, with the 5-pixel ellipse."""
    kernel = ellipse_kernel(5)
    steps = [("dilate", kernel, 1), ("erode", kernel, 2), ("dilate", kernel, 1)]
    return morphology(runs, dims, steps)


def _largest(dims: DataFrame, length: Column | int) -> int:
    """Largest of a length over the frames; it sets how many passes a plan has."""
    return length if isinstance(length, int) else int(dims.agg(F.max(length)).first()[0] or 0)


def gap_radius(close_gap: float = 0.025) -> Column:
    """Radius of the odd ellipse that closes gaps; it follows the shorter side of each frame."""
    diameter = F.greatest(F.lit(1), half_even(F.least("height", "width") * F.lit(close_gap)))
    return F.floor(diameter / 2).cast("int")


def close_gaps(runs: DataFrame, dims: DataFrame, close_gap: float = 0.025) -> DataFrame:
    """Close with an ellipse of each frame's own size."""
    radius, r = gap_radius(close_gap), F.col("_r").cast("double")
    most = _largest(dims, radius)
    half = lambda dy: F.when(r > 0, half_even(r * F.sqrt(1 - dy * dy / (r * r)))).otherwise(0)
    kernel = [(dy, F.when(F.col("_r") >= abs(dy), half(dy))) for dy in range(-most, most + 1)]
    return morphology(runs, dims, [("dilate", kernel, 1), ("erode", kernel, 1)], reach=radius)


def box_steps(radius: int) -> list[list[tuple[int, int]]]:
    """Small kernels that together dilate by a square of the given radius.

    A shape already ``2r+1`` rows tall grows by up to ``2r+1`` rows when shifted up and down
    once, so each pass triples the radius: rows multiply by 3 per pass instead of ``2r+1``.
    """
    steps, have = [], 0
    while have < radius:
        shift = min(2 * have + 1, radius - have)
        steps.append([(-shift, shift), (0, shift), (shift, shift)])
        have += shift
    return steps


def boundary_width(ratio: float) -> Column:
    """Radius of the boundary band of each frame: a share of its diagonal, one pixel at least."""
    if not 0 < ratio <= 1:
        raise ValueError("boundary ratio must lie in (0, 1]")
    h, w = F.col("height").cast("double"), F.col("width").cast("double")
    return F.greatest(F.lit(1), half_even(F.lit(float(ratio)) * F.sqrt(h * h + w * w))).cast("int")


def inner_runs(
    runs: DataFrame, dims: DataFrame, radius: Column | int, frame: Sequence[str] = FRAME
) -> DataFrame:
    """Pixels further than ``radius`` from background, counting everything outside as background.

    The radius may be a column of the frames' sizes.
    """
    canvas = _flip(to_canvas(runs, dims, frame, radius), frame)
    r, have = F.col("_r"), 0
    for kernel in box_steps(_largest(dims, radius)):
        if isinstance(radius, Column):
            shift = F.greatest(F.lit(0), F.least(F.lit(2 * have + 1), r - have))
            kernel = [(-shift, shift), (0, shift), (shift, shift)]
        canvas = _grow(canvas, kernel, frame)
        have = 3 * have + 1
    kept = _flip(canvas, frame)
    clipped = kept.filter((F.col("y") >= r) & (F.col("y") < F.col("_h") - r) & ~_is_border()).select(
        *row_keys(frame),
        F.greatest(F.col("x0"), r).cast("int").alias("x0"),
        F.least(F.col("x1"), F.col("_w") - r).cast("int").alias("x1"),
    )
    return clipped.filter(F.col("x1") > F.col("x0"))


def boundary_band(runs: DataFrame, dims: DataFrame, radius: Column | int) -> DataFrame:
    """Road pixels within ``radius`` of the background. ``runs`` must be merged."""
    return subtract_runs(runs, inner_runs(runs, dims, radius))


# ---------------------------------------------------------------- resizing and augmentation


def _ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("int")


def scale_runs(
    runs: DataFrame,
    src_h: str | Column,
    src_w: str | Column,
    dst_h: str | Column,
    dst_w: str | Column,
    extra: Sequence[str] = (),
    always: Column | None = None,
) -> DataFrame:
    """Nearest-neighbour resize: target pixel ``d`` shows source pixel ``floor(d*src/dst)``.

    Spans that no target pixel shows disappear, except those marked by ``always``.
    """
    sh, sw = (F.col(c) if isinstance(c, str) else c for c in (src_h, src_w))
    dh, dw = (F.col(c) if isinstance(c, str) else c for c in (dst_h, dst_w))
    keep = F.lit(False) if always is None else always
    sized = runs.select(
        *FRAME,
        *extra,
        keep.alias("_always"),
        _ceil_div(F.col("y") * dh, sh).alias("_a"),
        (_ceil_div((F.col("y") + 1) * dh, sh) - 1).alias("_b"),
        _ceil_div(F.col("x0") * dw, sw).alias("x0"),
        _ceil_div(F.col("x1") * dw, sw).alias("x1"),
    )
    shown = (F.col("_b") >= F.col("_a")) & (F.col("x1") > F.col("x0"))
    rows = F.when(F.col("_always"), F.array(F.lit(0))).otherwise(F.sequence("_a", "_b"))
    kept = sized.filter(shown | F.col("_always"))
    return kept.select(*FRAME, *extra, F.explode(rows).alias("y"), "x0", "x1")


# A span outside the shape its transform names is an error. The flag ``_ok`` travels with the span
# past every filter and the job stops at the end, so the check does not depend on the order
# in which the optimizer evaluates filters.


def _planned(runs: DataFrame, plans: DataFrame, height: str, width: str) -> DataFrame:
    """Spans with their frame's ``plan`` and the flag for lying inside ``plan.height x plan.width``."""
    c = F.col
    inside = (
        (c("y") >= 0) & (c("y") < c(f"plan.{height}")) & (c("x0") >= 0) & (c("x1") <= c(f"plan.{width}"))
    )
    return runs.join(plans.select(*FRAME, "plan"), list(FRAME)).withColumn("_ok", inside)


def _stop_outside(runs: DataFrame, y: Column, x0: Column, x1: Column) -> DataFrame:
    stop = F.raise_error(F.lit("span outside the shape named by its transform")).cast("int")
    return runs.select(
        *FRAME,
        F.when(F.col("_ok"), y).otherwise(stop).cast("int").alias("y"),
        x0.cast("int").alias("x0"),
        x1.cast("int").alias("x1"),
    )


def apply_mask(runs: DataFrame, plans: DataFrame) -> DataFrame:
    """Full-frame spans to model-canvas spans. ``plans`` holds ``plan`` per frame."""
    c = F.col
    t = lambda name: c(f"plan.{name}")
    joined = _planned(runs, plans, "original_height", "original_width")
    roi = joined.filter((c("y") >= t("roi_y")) | ~c("_ok")).withColumn("y", c("y") - t("roi_y"))
    small = scale_runs(
        roi,
        t("original_height") - t("roi_y"),
        t("original_width"),
        t("content_height"),
        t("content_width"),
        ["plan", "_ok"],
        ~c("_ok"),
    )
    return _stop_outside(small, c("y") + t("top"), c("x0") + t("left"), c("x1") + t("left"))


def _unpadded(runs: DataFrame, plans: DataFrame) -> DataFrame:
    c = F.col
    t = lambda name: c(f"plan.{name}")
    cut = _planned(runs, plans, "input_height", "input_width").withColumns(
        {
            "y": c("y") - t("top"),
            "x0": F.greatest(F.lit(0), c("x0") - t("left")),
            "x1": F.least(t("content_width"), c("x1") - t("left")),
        }
    )
    inside = (c("y") >= 0) & (c("y") < t("content_height")) & (c("x1") > c("x0"))
    return cut.filter(inside | ~c("_ok"))


def unpad_runs(runs: DataFrame, plans: DataFrame) -> DataFrame:
    """Canvas spans to content spans; padding never becomes road."""
    return _stop_outside(_unpadded(runs, plans), F.col("y"), F.col("x0"), F.col("x1"))


def restore_runs(runs: DataFrame, plans: DataFrame, already_unpadded: bool = False) -> DataFrame:
    """Canvas (or content) spans back to the full frame; rows above the crop stay background."""
    c = F.col
    t = lambda name: c(f"plan.{name}")
    small = _planned(runs, plans, "content_height", "content_width") if already_unpadded else _unpadded(runs, plans)
    big = scale_runs(
        small,
        t("content_height"),
        t("content_width"),
        t("original_height") - t("roi_y"),
        t("original_width"),
        ["plan", "_ok"],
        ~c("_ok"),
    )
    return _stop_outside(big, c("y") + t("roi_y"), c("x0"), c("x1"))


def augment_runs(runs: DataFrame, plans: DataFrame) -> DataFrame:
    """Apply the geometric augmentation plan: optional mirror, then optional crop resized back.

    ``plans`` has ``height, width, flip, crop, crop_h, crop_w, crop_top, crop_left`` per frame.
    """
    c = F.col
    joined = runs.join(
        plans.select(*FRAME, "height", "width", "flip", "crop", "crop_h", "crop_w", "crop_top", "crop_left"),
        list(FRAME),
    )
    mirrored = joined.withColumns(
        {
            "x0": F.when(c("flip"), c("width") - c("x1")).otherwise(c("x0")).cast("int"),
            "x1": F.when(c("flip"), c("width") - c("x0")).otherwise(c("x1")).cast("int"),
        }
    )
    kept = mirrored.filter(~c("crop")).select(*FRAME, "y", "x0", "x1")
    window = mirrored.filter(c("crop")).withColumns(
        {
            "y": (c("y") - c("crop_top")).cast("int"),
            "x0": F.greatest(F.lit(0), c("x0") - c("crop_left")).cast("int"),
            "x1": F.least(c("crop_w"), c("x1") - c("crop_left")).cast("int"),
        }
    )
    window = window.filter((c("y") >= 0) & (c("y") < c("crop_h")) & (c("x1") > c("x0")))
    return kept.unionByName(scale_runs(window, "crop_h", "crop_w", "height", "width"))
