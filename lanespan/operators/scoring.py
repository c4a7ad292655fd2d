"""Segmentation quality, model comparison and numerical agreement of model outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespan.functions.exprs import probability_fault, ratio_or_null, ratio_or_one, stable_sigmoid
from lanespan.operators.runs import (
    FRAME,
    boundary_width,
    inner_runs,
    merge_runs,
    overlay_tagged,
    pixels_to_runs,
    restore_runs,
)

COUNTS = ("tp", "fp", "fn", "tn")


# ---------------------------------------------------------------- probability maps


def bad_probabilities(maps: DataFrame, values: str = "p") -> DataFrame:
    """Maps with a wrong size, a non-finite value or a value outside [0, 1]."""
    fault = probability_fault(values, "height", "width")
    return maps.select(*FRAME, fault.alias("fault")).filter(F.col("fault").isNotNull())


def good_probabilities(maps: DataFrame, values: str = "p") -> DataFrame:
    return maps.filter(probability_fault(values, "height", "width").isNull())


def to_probabilities(outputs: DataFrame, output_kind: str, values: str = "p") -> DataFrame:
    """Turn raw model output into probabilities; ``probabilities`` pass through unchanged."""
    if output_kind not in ("logits", "probabilities"):
        raise ValueError("output_kind must be logits or probabilities")
    if output_kind == "probabilities":
        return outputs
    return outputs.withColumn(values, F.transform(values, stable_sigmoid))


def predicted_runs(maps: DataFrame, plans: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Full-frame prediction spans of model output: check, threshold inclusively, restore.

    ``maps`` holds canvas-sized ``p``; ``plans`` the letterbox ``plan`` per frame. A faulty map
    stops the job, because scoring the rest would hide it.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie in (0, 1)")
    fault = probability_fault("p", "height", "width")
    refuse = F.raise_error(F.concat(F.lit("bad probability map: "), fault)).cast("array<double>")
    checked = maps.withColumn("p", F.when(fault.isNull(), F.col("p").cast("array<double>")).otherwise(refuse))
    return restore_runs(pixels_to_runs(checked, threshold).drop("peak"), plans)


# ---------------------------------------------------------------- per-frame facts


def frame_facts(
    prediction: DataFrame,
    truth: DataFrame,
    dims: DataFrame,
    boundary_radius: Column | int | None = None,
) -> DataFrame:
    """Pixel counts per frame; raw spans are accepted and every frame of ``dims`` appears.

    With a ``boundary_radius`` (a number, or a column of the frames' sizes) the boundary bands are compared as well. Both masks travel as
    layers of one table, so morphology and counting share their shuffles.
    """
    size = (F.col("x1") - F.col("x0")).cast("long")
    columns = [*FRAME, "y", "x0", "x1"]
    names = ["p", "t"]
    tagged = prediction.select(*columns, F.lit("p").alias("layer")).unionByName(
        truth.select(*columns, F.lit("t").alias("layer"))
    )
    if boundary_radius is not None:
        layered = [*FRAME, "layer"]
        both = F.explode(F.array(F.lit("p"), F.lit("t"))).alias("layer")
        tagged = merge_runs(tagged, layered)
        inner = inner_runs(tagged, dims.select("*", both), boundary_radius, layered)
        tagged = tagged.unionByName(inner.withColumn("layer", F.concat("layer", F.lit("_inner"))))
        names += ["p_inner", "t_inner"]
    pieces = overlay_tagged(tagged, names)
    p, t = F.col("p"), F.col("t")

    def pixels(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, size).otherwise(0)).alias(name)

    sums = [pixels(p & t, "tp"), pixels(p & ~t, "fp"), pixels(~p & t, "fn")]
    reach = [F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x0").alias("_x0"), F.max("x1").alias("_x1")]
    if boundary_radius is not None:
        bp, bt = p & ~F.col("p_inner"), t & ~F.col("t_inner")
        sums += [pixels(bp & bt, "boundary_intersection"), pixels(bp | bt, "boundary_union")]
    counted = pieces.groupBy(*FRAME).agg(*sums, *reach)
    names = [c for c in counted.columns if c not in FRAME and not c.startswith("_")]
    # A frame of unknown size or a span outside its frame would make every score wrong.
    outside = (F.col("_y0") < 0) | (F.col("_x0") < 0) | (F.col("_y1") >= F.col("height")) | (F.col("_x1") > F.col("width"))
    fault = F.when(F.col("height").isNull() | F.col("width").isNull(), "frame without dims").when(outside, "span outside its frame")
    refuse = F.raise_error(F.concat(fault, F.lit(": "), F.col("group"), F.lit(" "), F.col("frame_idx"))).cast("long")
    size_of = (F.col("height") * F.col("width")).cast("long")
    filled = dims.join(counted, list(FRAME), "full").select(
        *FRAME,
        F.when(fault.isNull(), size_of).otherwise(refuse).alias("pixels"),
        *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names],
    )
    negative = (F.col("tp") + F.col("fn")) == 0
    return filled.withColumns(
        {"tn": F.col("pixels") - F.col("tp") - F.col("fp") - F.col("fn"), "negative": negative}
    )


def confusion(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return facts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])


def segmentation_scores(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro-averaged scores over all pixels of the set."""
    c = F.col
    totals = confusion(facts, by)
    return totals.select(
        *by,
        *COUNTS,
        ratio_or_one("tp", c("tp") + c("fp") + c("fn")).alias("iou"),
        ratio_or_one(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("dice_f1"),
        ratio_or_one("tp", c("tp") + c("fp")).alias("precision"),
        ratio_or_one("tp", c("tp") + c("fn")).alias("recall"),
    )


def boundary_iou(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    totals = facts.groupBy(*by).agg(
        F.sum("boundary_intersection").alias("boundary_intersection"),
        F.sum("boundary_union").alias("boundary_union"),
    )
    return totals.withColumn("boundary_iou", ratio_or_one("boundary_intersection", "boundary_union"))


def negative_rates(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False-positive shares on frames without road; null where there are none."""
    n = F.col("negative")
    totals = facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(n).alias("negative_frames"),
        F.sum(F.when(n, F.col("pixels")).otherwise(0)).alias("negative_pixels"),
        F.sum(F.when(n, F.col("fp")).otherwise(0)).alias("negative_false_pixels"),
        F.count_if(n & (F.col("fp") > 0)).alias("negative_false_frames"),
    )
    return totals.withColumns(
        {
            "no_road_pixel_fpr": ratio_or_null("negative_false_pixels", "negative_pixels"),
            "no_road_frame_fpr": ratio_or_null("negative_false_frames", "negative_frames"),
        }
    )


def evaluation_report(
    prediction: DataFrame, truth: DataFrame, dims: DataFrame, boundary_ratio: float = 0.02
) -> DataFrame:
    """All quality numbers of one model in one row, from a single table of frame facts."""
    facts = frame_facts(prediction, truth, dims, boundary_width(boundary_ratio))
    c = F.col
    sums = [*COUNTS, "boundary_intersection", "boundary_union"]
    n = c("negative")
    totals = facts.agg(
        *[F.sum(s).alias(s) for s in sums],
        F.count(F.lit(1)).alias("frames"),
        F.count_if(n).alias("negative_frames"),
        F.sum(F.when(n, c("pixels")).otherwise(0)).alias("_np"),
        F.sum(F.when(n, c("fp")).otherwise(0)).alias("_nfp"),
        F.count_if(n & (c("fp") > 0)).alias("_nff"),
    )
    return totals.select(
        ratio_or_one("tp", c("tp") + c("fp") + c("fn")).alias("iou"),
        ratio_or_one(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("dice_f1"),
        ratio_or_one("tp", c("tp") + c("fp")).alias("precision"),
        ratio_or_one("tp", c("tp") + c("fn")).alias("recall"),
        ratio_or_one("boundary_intersection", "boundary_union").alias("boundary_iou"),
        ratio_or_null("_nfp", "_np").alias("no_road_pixel_fpr"),
        ratio_or_null("_nff", "negative_frames").alias("no_road_frame_fpr"),
        "frames",
        "negative_frames",
        *COUNTS,
        F.lit(float(boundary_ratio)).alias("boundary_ratio"),
    )


# ---------------------------------------------------------------- comparison


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Frame facts of two models on the same frames, side by side; a frame that one model lacks is an error."""
    left = baseline.select(*FRAME, *[F.col(c).alias(f"baseline_{c}") for c in COUNTS])
    right = candidate.select(*FRAME, *[F.col(c).alias(f"candidate_{c}") for c in COUNTS])
    return _both(left, right, "baseline_tp", "candidate_tp")


def _both(left: DataFrame, right: DataFrame, mine: str, theirs: str) -> DataFrame:
    """Join of two tables that must hold the same frames."""
    lone = F.col(mine).isNull() | F.col(theirs).isNull()
    refuse = F.raise_error(F.concat(F.lit("only one side has frame "), F.col("group"), F.lit(" "), F.col("frame_idx")))
    joined = left.join(right, list(FRAME), "full")
    return joined.withColumn("group", F.when(lone, refuse.cast("string")).otherwise(F.col("group")))


def comparison_scores(joined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sums = [F.sum(f"{m}_{c}").alias(f"{m}_{c}") for m in ("baseline", "candidate") for c in COUNTS]

    def iou(m: str) -> Column:
        return ratio_or_one(f"{m}_tp", F.col(f"{m}_tp") + F.col(f"{m}_fp") + F.col(f"{m}_fn"))

    totals = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), *sums)
    return totals.select(
        *by,
        "frames",
        iou("baseline").alias("baseline_iou"),
        iou("candidate").alias("candidate_iou"),
        ((iou("candidate") - iou("baseline")) * 100).alias("iou_delta_points"),
    )


def comparison_gate(pairs: DataFrame, max_drop: float = 0.02, enforce: bool = False) -> DataFrame:
    """Accept or reject a candidate by its IoU drop.

    ``pairs`` carries baseline and candidate ``iou``, ``boundary_iou``, ``mean_ms`` and the
    candidate's ``quantized`` flag; other columns pass through.
    """
    if not 0 <= max_drop <= 1:
        raise ValueError("max_drop must lie in [0, 1]")
    c = F.col
    delta = c("candidate_iou") - c("baseline_iou")
    exceeded = delta < -max_drop - 1e-12
    boundary_delta = c("candidate_boundary_iou") - c("baseline_boundary_iou")
    return pairs.withColumns(
        {
            "iou_delta_points": delta * 100,
            "boundary_iou_delta_points": boundary_delta * 100,
            "iou_drop_within_limit": ~exceeded,
            "acceptance_gate_failed": exceeded & (F.coalesce(c("quantized"), F.lit(False)) | F.lit(enforce)),
            "inference_speedup": c("baseline_mean_ms") / c("candidate_mean_ms"),
        }
    )


# ---------------------------------------------------------------- numerical agreement and loss


def backend_metadata_agrees(left: dict, right: dict) -> bool:
    """Outputs are comparable only if model and preprocessing are the same."""
    names = ("input_width", "input_height", "roi_top", "preprocess_version", "architecture")
    return all(left[n] == right[n] for n in names)


def backend_pairs(expected: DataFrame, actual: DataFrame, left: dict, right: dict) -> DataFrame:
    """Outputs of two backends side by side, refused when their models differ."""
    if not backend_metadata_agrees(left, right):
        raise ValueError("backends with different model or preprocessing metadata cannot be compared")
    return _both(expected.select(*FRAME, F.col("p").alias("expected")), actual.select(*FRAME, F.col("p").alias("actual")), "expected", "actual")


def backend_parity(
    pairs: DataFrame, by: Sequence[str] = (), atol: float = 1e-5, rtol: float = 1e-4
) -> DataFrame:
    """Largest error, mean of the frame means, and whether every value is within tolerance.

    Outputs of different lengths and a comparison of no outputs at all are errors.
    """
    pairs = pairs.withColumn("expected", _as_long_as("expected", "actual"))
    differences = F.zip_with("expected", "actual", lambda e, a: F.abs(e.cast("double") - a))
    within = F.zip_with(
        "expected",
        "actual",
        lambda e, a: F.abs(e.cast("double") - a) <= atol + rtol * F.abs(e.cast("double")),
    )
    facts = pairs.withColumn("_d", differences).select(
        *by,
        F.array_max("_d").alias("max_error"),
        (F.aggregate("_d", F.lit(0.0), lambda s, v: s + v) / F.size("_d")).alias("mean_error"),
        F.forall(within, lambda ok: ok).alias("within"),
    )
    frames = F.count(F.lit(1))
    if not by:
        frames = F.when(frames > 0, frames).otherwise(F.raise_error(F.lit("no outputs to compare")).cast("long"))
    return facts.groupBy(*by).agg(
        frames.alias("frames"),
        F.max("max_error").alias("max_abs_error"),
        F.avg("mean_error").alias("mean_abs_error"),
        F.bool_and("within").alias("within_tolerance"),
    )


def _as_long_as(column: str, other: str) -> Column:
    """The array, or an error where it is null, empty or not as long as the other."""
    same = F.coalesce((F.size(column) == F.size(other)) & (F.size(column) > 0), F.lit(False))
    kind = "array<double>"
    return F.when(same, F.col(column).cast(kind)).otherwise(F.raise_error(F.lit(f"{column} and {other} differ in shape")).cast(kind))


def sample_loss(logits: str = "logit", targets: str = "target") -> Column:
    """Mean binary cross-entropy on logits plus the smoothed Dice loss of one sample."""
    terms = F.zip_with(
        logits,
        targets,
        lambda x, t: F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x))),
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    p = F.transform(logits, stable_sigmoid)
    overlap = total(F.zip_with(p, targets, lambda a, t: a * t))
    dice = 1 - (2 * overlap + 1) / (total(p) + total(F.col(targets)) + 1)
    return total(terms) / F.size(logits) + dice


def segmentation_loss(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sample-weighted mean loss, independent of how samples were batched."""
    return (
        samples.withColumn("logit", _as_long_as("logit", "target"))
        .select(*by, sample_loss().alias("_loss"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("samples"), F.avg("_loss").alias("loss"))
    )
