"""Connected components of masks and the selections built on them.

Reachability inside one frame has no fixed number of joins: a driver loop of joins would
shuffle every span once per round. Spark therefore places and sorts whole frames (bounded by
their raster), and one Arrow pass labels all frames of a batch at once. A frame too large for that is labelled in bands, and
only the borders of bands are joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanespan.functions.exprs import percent_of
from lanespan.functions.ordered import with_position
from lanespan.operators.runs import (
    FRAME,
    close_gaps,
    co_locate,
    complement_runs,
    legacy_cleanup,
    pixels_to_runs,
    row_keys,
    with_dims,
)
from lanespan.session import materialize


def _label_frames(spans: pd.DataFrame, frame_no: np.ndarray) -> np.ndarray:
    """Component number per span, counted from 1 in each frame in order of first appearance.

    Rows are sorted by frame, row, start, and rows hold disjoint spans, so the spans of the next
    row that touch a span (diagonals included) are one slice found by binary search.
    """
    y, x0, x1 = (spans[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    y = y - y.min()
    row = frame_no * (y.max() + 2) + y
    stride = x1.max() + 2
    low = np.searchsorted(row * stride + x1, (row + 1) * stride + x0, "left")
    high = np.searchsorted(row * stride + x0, (row + 1) * stride + x1, "right")
    n_touching = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(y)), n_touching)
    first = np.repeat(np.cumsum(n_touching) - n_touching, n_touching)
    lower = np.repeat(low, n_touching) + np.arange(len(upper)) - first

    label = np.arange(len(y))
    while True:
        before = label.copy()
        smaller = np.minimum(label[upper], label[lower])
        np.minimum.at(label, label[upper], smaller)
        np.minimum.at(label, label[lower], smaller)
        label = label[label]
        if np.array_equal(before, label):
            break
    roots, component = np.unique(label, return_inverse=True)
    first_of_frame = np.searchsorted(frame_no[roots], frame_no)
    return component - first_of_frame + 1


def _label_batches(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Label the complete frames of each batch; the unfinished last frame waits for the next."""
    waiting = None
    for batch in batches:
        rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        if rows.empty:
            continue
        last = (rows[list(keys)] == rows[list(keys)].iloc[-1]).all(axis=1).to_numpy()
        waiting = rows[last].reset_index(drop=True)
        yield from _labelled(rows[~last].reset_index(drop=True), keys)
    if waiting is not None:
        yield from _labelled(waiting, keys)


def _labelled(rows: pd.DataFrame, keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    if not rows.empty:
        frame_no = rows.groupby(list(keys), sort=False).ngroup().to_numpy(np.int64)
        yield rows.assign(component=_label_frames(rows, frame_no).astype(np.int32))


def label_components(
    runs: DataFrame, carry: Sequence[str] = (), frame: Sequence[str] = FRAME
) -> DataFrame:
    """8-connected components of merged spans as an extra ``component`` column."""
    keys = list(frame)
    columns = [*keys, "y", "x0", "x1", *carry]
    placed = co_locate(runs.select(*columns), keys, heavy=True).sortWithinPartitions(*keys, "y", "x0")
    schema = T.StructType([*placed.schema.fields, T.StructField("component", T.IntegerType())])
    return placed.mapInPandas(lambda batches: _label_batches(batches, keys), schema)


#: Columns of a frame within which spans of neighbouring bands are compared.
STRIPE = 256


def label_tiles(
    runs: DataFrame, band: int = 4096, carry: Sequence[str] = (), frame: Sequence[str] = FRAME
) -> DataFrame:
    """As :func:`label_components`, for frames too large for one task: bands of ``band`` rows are labelled side by side.

    Components of neighbouring bands that touch are joined by contraction: every one goes to the smallest it touches, and what is
    left between those is contracted again until nothing touches. Only the border rows and one row per component and band
    take part. Numbers count by first span, as without bands.
    """
    if band < 1:
        raise ValueError("a band needs a row at least")
    keys, c = list(frame), F.col
    columns = [*keys, "_band", "y", "x0", "x1", *carry]
    banded = runs.withColumn("_band", F.floor(c("y") / band).cast("long")).select(*columns)
    # Written once: the borders, the list of components and the result read it.
    local = materialize(label_components(banded, carry, [*keys, "_band"]).withColumn("_node", c("_band") * (1 << 32) + c("component")))

    def border(offset: int, shift: int, name: str) -> DataFrame:
        rows = local.filter(F.pmod("y", F.lit(band)) == offset)
        stripes = F.explode(F.sequence(F.floor(c("x0") / STRIPE), F.floor(c("x1") / STRIPE)))
        ends = [c("x0").alias(f"{name}_from"), c("x1").alias(f"{name}_to"), c("_node").alias(name)]
        return rows.select(*keys, (c("y") + shift).alias("y"), stripes.alias("_stripe"), *ends)

    touching = (c("a_from") <= c("b_to")) & (c("b_from") <= c("a_to"))
    edges = border(band - 1, 1, "a").join(border(0, 0, "b"), [*keys, "y", "_stripe"]).filter(touching).select(*keys, "a", "b")
    nodes = local.select(*keys, "_node").distinct().withColumn("_root", c("_node"))
    while True:
        edges = materialize(edges.distinct())
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(*keys, c("a").alias("b"), c("b").alias("a")))
        least = materialize(both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.min("a")).alias("_to")))
        nodes = nodes.join(least.withColumnRenamed("a", "_root"), [*keys, "_root"], "left")
        nodes = materialize(nodes.select(*keys, "_node", F.coalesce("_to", "_root").alias("_root")))
        for end in ("a", "b"):
            moved = least.select(*keys, c("a").alias(end), "_to")
            edges = edges.join(moved, [*keys, end]).drop(end).withColumnRenamed("_to", end)
        edges = edges.filter(c("a") != c("b")).select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = nodes.filter("_node = _root").select(*keys, "_root")
    numbered = with_position(roots, keys, ["_root"], F.floor(c("_root") / (1 << 32)).cast("long"), "_number")
    labels = nodes.join(numbered, [*keys, "_root"]).select(*keys, "_node", (c("_number") + 1).cast("int").alias("component"))
    return local.drop("component").join(labels, [*keys, "_node"]).select(*keys, "y", "x0", "x1", *carry, "component")


def hysteresis(
    maps: DataFrame, low: float = 0.40, high: float = 0.65, values: str = "p", keep: Sequence[str] = FRAME
) -> DataFrame:
    """Components of ``p >= low`` that contain a pixel with ``p >= high``."""
    if not 0 <= low <= high <= 1:
        raise ValueError("hysteresis needs 0 <= low <= high <= 1")
    labelled = label_components(pixels_to_runs(maps, low, values, keep), ["peak"], keep)
    whole = Window.partitionBy(*keep, "component")
    seeded = labelled.withColumn("_peak", F.max("peak").over(whole)).filter(F.col("_peak") >= high)
    return seeded.select(*keep, "y", "x0", "x1")


# ---------------------------------------------------------------- statistics


def _with_stats(labelled: DataFrame, dims: DataFrame, bottom_fraction: float) -> DataFrame:
    """Spans with the totals of their component, from windows over one placement of the frame.

    A column counts once per component: ordered by start, a lower span adds only the columns
    beyond the reach of those before it.
    """
    c = F.col
    lower = c("y") >= percent_of("_h", 1 - bottom_fraction)
    spans = co_locate(with_dims(labelled, dims)).withColumn("_lower", lower)
    whole = Window.partitionBy(*FRAME, "component")
    sweep = Window.partitionBy(*FRAME, "component", "_lower").orderBy("x0", "x1", "y")
    reach = F.max("x1").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    start = F.greatest(c("x0"), F.coalesce(reach, F.lit(0)))
    fresh = spans.withColumn("_start", start).withColumn(
        "_n", F.when(c("_lower"), F.greatest(F.lit(0), c("x1") - c("_start"))).otherwise(0)
    )
    columns = F.sum("_n").over(whole)
    places = F.sum(c("_n") * (c("_start") + c("x1") - 1) / 2).over(whole)
    return fresh.withColumns(
        {
            "area": F.sum(c("x1") - c("x0")).over(whole).cast("long"),
            "top": F.min("y").over(whole),
            "bottom": F.max("y").over(whole),
            "touches_lower": F.max("_lower").over(whole),
            "lower_mean_x": F.when(columns > 0, places / columns),
        }
    ).drop("_start", "_n", "_lower")


def component_stats(labelled: DataFrame, dims: DataFrame, bottom_fraction: float = 0.20) -> DataFrame:
    """Per component: area, rows spanned, contact with the lower band, and there the mean of
    the distinct columns it covers."""
    names = ("area", "top", "bottom", "touches_lower", "lower_mean_x")
    totals = _with_stats(labelled, dims, bottom_fraction).groupBy(*FRAME, "component")
    return totals.agg(*[F.first(n).alias(n) for n in names])


def fill_small_holes(runs: DataFrame, dims: DataFrame, max_hole_area: float = 0.004) -> DataFrame:
    """Turn small background components that do not reach the border into road.

    What remains of the background is kept, and road is everything else.
    """
    holes = co_locate(with_dims(label_components(complement_runs(runs, dims)), dims))
    area = F.sum(F.col("x1") - F.col("x0"))
    at_border = F.max(
        (F.col("y") == 0)
        | (F.col("y") == F.col("_h") - 1)
        | (F.col("x0") == 0)
        | (F.col("x1") == F.col("_w"))
    )
    whole = Window.partitionBy(*FRAME, "component")
    limit = F.col("_h") * F.col("_w") * F.lit(float(max_hole_area))
    background = holes.withColumns({"_area": area.over(whole), "_border": at_border.over(whole)}).filter(
        F.col("_border") | (F.col("_area") > limit)
    )
    return complement_runs(background.select(*row_keys(), "x0", "x1"), dims)


def _keep_best(spans: DataFrame, allowed: Column, score: Column) -> DataFrame:
    """Keep each frame's highest-scoring component; on a tie the later component wins.

    ``spans`` are placed by frame and carry the totals of their component.
    """
    candidate = F.when(allowed, F.struct(score.alias("s"), F.col("component")))
    best = F.max(candidate).over(Window.partitionBy(*FRAME))
    chosen = spans.withColumn("_best", best).filter(F.col("_best.component") == F.col("component"))
    return chosen.select(*row_keys(), "x0", "x1")


def primary_component(
    labelled: DataFrame, dims: DataFrame, min_area: int | None = None, bottom_fraction: float = 0.42
) -> DataFrame:
    """Scanline policy: large, low components first (``area + 3 * row below the last``).

    Without ``min_area`` the least area follows each frame's size.
    """
    least = default_min_area("_h", "_w") if min_area is None else F.lit(min_area)
    whole = Window.partitionBy(*FRAME, "component")
    spans = co_locate(with_dims(labelled, dims)).withColumns(
        {
            "area": F.sum(F.col("x1") - F.col("x0")).over(whole),
            "below": F.max("y").over(whole) + 1,
        }
    )
    allowed = (F.col("area") >= least) & (F.col("below") >= percent_of("_h", 1 - bottom_fraction))
    return _keep_best(spans, allowed, F.col("area") + 3 * F.col("below"))


def default_min_area(height: str = "height", width: str = "width") -> Column:
    return F.greatest(F.lit(8), F.floor(F.col(height).cast("long") * F.col(width) / 700))


def origin_component(
    labelled: DataFrame,
    dims: DataFrame,
    min_component_area: float = 0.003,
    bottom_fraction: float = 0.20,
) -> DataFrame:
    """Centerline policy: low, central and large components among those in the lower band."""
    c = F.col
    spans = _with_stats(labelled, dims, bottom_fraction)
    least = F.greatest(F.lit(4.0), c("_h") * c("_w") * F.lit(float(min_component_area)))
    offset = F.abs(c("lower_mean_x") - (c("_w") - 1) / 2) / F.greatest(F.lit(1), c("_w"))
    score = 4 * c("bottom") / F.greatest(F.lit(1), c("_h")) - offset + F.log1p(c("area").cast("double")) / 10
    return _keep_best(spans, c("touches_lower") & (c("area") >= least), score)


def primary_road(runs: DataFrame, dims: DataFrame, min_area: int | None = None) -> DataFrame:
    """Legacy road mask: morphological cleanup, then the primary component."""
    return primary_component(label_components(legacy_cleanup(runs, dims)), dims, min_area)


def clean_road(runs: DataFrame, dims: DataFrame) -> DataFrame:
    """Centerline road mask: close gaps, fill holes, keep the component at the origin."""
    closed = close_gaps(runs, dims)
    return origin_component(label_components(fill_small_holes(closed, dims)), dims)


def anchor_component(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Keep the component under each frame's anchor pixel, else its largest (earliest on ties).

    ``anchors`` has ``ax, ay`` per frame; they may be null or fall on background.
    """
    c = F.col
    places = anchors.select(*FRAME, "ax", "ay")
    hit = (c("y") == c("ay")) & (c("x0") <= c("ax")) & (c("ax") < c("x1"))
    whole = Window.partitionBy(*FRAME, "component")
    spans = co_locate(label_components(runs).join(places, list(FRAME), "left")).withColumn(
        "_hit", F.coalesce(hit, F.lit(False))
    )
    totals = spans.withColumns(
        {"_hit": F.max("_hit").over(whole), "area": F.sum(c("x1") - c("x0")).over(whole)}
    )
    rank = F.struct(c("_hit").alias("hit"), c("area").alias("area"), (-c("component")).alias("first"))
    best = F.max(rank).over(Window.partitionBy(*FRAME))
    chosen = totals.withColumn("_best", best).filter(c("_best.first") == -c("component"))
    return chosen.select(*row_keys(), "x0", "x1")
