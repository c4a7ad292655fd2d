"""Run telemetry: warm-up, stage latencies, frame rates, load shedding and accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanespan.functions.exprs import STAGES
from lanespan.functions.ordered import block_of, with_halo, with_position
from lanespan.functions.quantiles import exact_percentiles
from lanespan.session import materialize

RUN = ("run_id",)


def drop_warmup(completions: DataFrame, warmup: int = 30) -> DataFrame:
    """Remove the first frames of every run; ``pos`` counts the remaining ones from zero."""
    if warmup < 0:
        raise ValueError("warm-up cannot be negative")
    ranked = with_position(completions, RUN, ["frame_seq"], block_of("frame_seq"))
    return ranked.filter(F.col("pos") >= warmup).withColumn("pos", F.col("pos") - warmup)


def latency_summary(times: DataFrame, value: str = "ms", by: Sequence[str] = ()) -> DataFrame:
    """Mean, median and 95th percentile in milliseconds, and the rate the mean implies.

    A group without any measurement is absent; with no groups an empty input raises.
    """
    ranks = exact_percentiles(times, by, value, {"median_ms": 0.5, "p95_ms": 0.95})
    n, mean = F.col("n"), F.col("mean")
    empty = F.raise_error(F.lit("no measured frames")).cast("long")
    return ranks.select(
        *by,
        (n if by else F.when(n > 0, n).otherwise(empty)).alias("frames"),
        mean.alias("mean_ms"),
        "median_ms",
        "p95_ms",
        (F.lit(1000.0) / F.nullif(mean, F.lit(0.0))).alias("fps"),
    )


def stage_times(measured: DataFrame, timings: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Milliseconds per measured frame and stage; an untimed stage counts as zero.

    ``total`` is the time from capture to completion, waiting included.
    """
    named = [s for s in stages if s != "total"]
    wide = timings.groupBy(*RUN, "frame_seq").agg(
        *[F.sum(F.when(F.col("stage") == s, F.col("seconds"))).alias(s) for s in named]
    )
    joined = measured.join(wide, [*RUN, "frame_seq"], "left")
    seconds = {s: F.coalesce(F.col(s), F.lit(0.0)) for s in named}
    if "total" in stages:
        seconds["total"] = F.col("completed_at") - F.col("captured_at")
    rows = F.explode(
        F.array(*[F.struct(F.lit(s).alias("stage"), (v * 1000).alias("ms")) for s, v in seconds.items()])
    )
    return joined.select(*RUN, "frame_seq", rows.alias("_r")).select(*RUN, "frame_seq", "_r.stage", "_r.ms")


def _every(keys: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Results of all keys: no frames and nulls where nothing was measured."""
    joined = keys.join(found, list(on), "left")
    return joined.withColumn("frames", F.coalesce("frames", F.lit(0).cast("long"))) if "frames" in found.columns else joined


def stage_summary(completions: DataFrame, timings: DataFrame, warmup: int = 30, stages: Sequence[str] = STAGES) -> DataFrame:
    """Mean, median and 95th percentile per run and stage after the warm-up.

    A run that ends within the warm-up has every stage with no frames and nulls. The measured times are written once, because
    the exact percentiles read them several times.
    """
    times = materialize(stage_times(drop_warmup(completions, warmup), timings, stages))
    found = latency_summary(times, "ms", [*RUN, "stage"]).drop("fps")
    named = F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage")
    return _every(completions.select(*RUN).distinct().select(*RUN, named), found, [*RUN, "stage"])


def average_fps(measured: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Frames per second between first and last completion; null without a positive span.

    With ``runs``, a table with all runs, those without a measured frame appear as well.
    """
    n, span = F.col("frames"), F.col("_last") - F.col("_first")
    spans = measured.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("frames"),
        F.min("completed_at").alias("_first"),
        F.max("completed_at").alias("_last"),
    )
    rate = F.when((n >= 2) & (span > 0), (n - 1) / span)
    found = spans.select(*RUN, "frames", rate.alias("average_fps"))
    return found if runs is None else _every(runs.select(*RUN).distinct(), found, RUN)


def min_sustained_fps(measured: DataFrame, window: int = 30, runs: DataFrame | None = None) -> DataFrame:
    """Slowest rate over any ``window`` consecutive completions; null for shorter runs.

    With ``runs``, a table with all runs, those without a measured frame appear as well.
    """
    if window < 2:
        raise ValueError("the window needs at least two frames")
    spread, w, home = with_halo(measured, RUN, "pos", window - 1)
    timed = spread.withColumn("_span", F.col("completed_at") - F.lag("completed_at", window - 1).over(w))
    longest = timed.filter(home).groupBy(*RUN).agg(F.max("_span").alias("_span"))
    rate = F.when(F.col("_span") > 0, F.lit(float(window - 1)) / F.col("_span"))
    found = longest.select(*RUN, rate.alias("min_sustained_fps"))
    return found if runs is None else _every(runs.select(*RUN).distinct(), found, RUN)


def latest_frames(waiting: DataFrame, queue_size: int = 2) -> DataFrame:
    """Camera rule: keep the newest waiting frames of each source, in order.

    The rank limit is applied inside each input partition before the shuffle.
    """
    if queue_size not in (2, 3):
        raise ValueError("the queue holds two or three frames")
    newest = Window.partitionBy("group").orderBy(F.col("frame_idx").desc())
    return waiting.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= queue_size).drop("_n")


def dropped_frames(waiting: DataFrame, queue_size: int = 2) -> DataFrame:
    """Per source, frames read, kept for processing and dropped."""
    read = waiting.groupBy("group").agg(F.count(F.lit(1)).alias("frames_read"))
    kept = F.least(F.col("frames_read"), F.lit(queue_size).cast("long"))
    return read.withColumns({"frames_processed": kept, "frames_dropped": F.col("frames_read") - kept})


def accounting_fault() -> Column:
    """First accounting rule a run breaks. Interrupted runs are exempt."""
    c = F.col
    whole_file = (c("source_mode") == "file") & ~c("interrupted")
    checked_output = c("has_output") & ~c("interrupted")
    return (
        F.when(whole_file & (c("frames_read") != c("frames_processed")), "processed differs from read")
        .when(whole_file & (c("expected") > 0) & (c("frames_read") != c("expected")), "read differs from source")
        .when(whole_file & c("has_output") & (c("frames_written") != c("frames_read")), "written differs from read")
        .when(
            checked_output
            & ((c("output_frames") != c("frames_written")) | (F.abs(c("output_fps") - c("source_fps")) > 0.01)),
            "output not preserved",
        )
    )


def frame_accounting(counters: DataFrame) -> DataFrame:
    return counters.select(
        "run_id",
        "frames_read",
        "frames_processed",
        "frames_written",
        "frames_dropped",
        accounting_fault().alias("fault"),
    )
