"""Training history: resuming and the best epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history_for_resume(history: DataFrame, start_epoch: int) -> DataFrame:
    """Records a resumed run keeps: everything up to the epoch it restarts from."""
    return history.filter(F.col("epoch") <= start_epoch)


def append_history(history: DataFrame, new: DataFrame, start_epoch: int) -> DataFrame:
    return history_for_resume(history, start_epoch).unionByName(new)


def running_best(history: DataFrame, score: str = "iou", resumed_best: float | None = None) -> DataFrame:
    """Best earlier score of each run and whether the epoch strictly beats it.

    A run has one row per epoch, so a run's history is small whatever the data size.
    """
    earlier = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(float("-inf") if resumed_best is None else float(resumed_best))
    best = F.greatest(F.coalesce(F.max(score).over(earlier), start), start)
    return history.withColumn("best_before", best).withColumn("improved", F.col(score) > F.col("best_before"))


def best_epoch(history: DataFrame, score: str = "iou") -> DataFrame:
    """Epoch whose weights are kept at the end: the highest score, earliest on ties."""
    rank = F.struct(F.col(score), -F.col("epoch"))
    return history.groupBy("run_id").agg(
        F.max_by("epoch", rank).alias("best_epoch"), F.max(score).alias("best_score"), F.count(F.lit(1)).alias("epochs")
    )
