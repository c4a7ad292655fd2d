"""Group-wise splitting and calibration sampling, both reproducible from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespan.functions.exprs import SPLITS, seeded_key
from lanespan.functions.ordered import with_position

# Shares of groups per split, and the allowed calibration sizes.
RATIOS = (0.70, 0.15, 0.15)
CALIBRATION_RANGE = (200, 500)


def cuts(n: Column) -> tuple[Column, Column]:
    """Where the second and the third split begin among ``n`` groups in order; fewer than three groups are an error.

    Whole shares first, one group at least. Of the at most two groups then left, the first goes where most of its share is missing, to
    the training split on a tie, and the second to the next split; with three groups the training split gives one up.
    """
    train, validation, test = (F.greatest(F.lit(1), F.floor(n * F.lit(share))) for share in RATIOS)
    left = n - train - validation - test
    train_first = n * F.lit(RATIOS[0]) - train >= n * F.lit(RATIOS[1]) - validation
    more = F.when(left < 0, left).when((left > 0) & train_first, 1).otherwise(0)
    second = F.when((left > 0) & ~train_first, 1).when((left > 1) & train_first, 1).otherwise(0)
    refuse = F.raise_error(F.lit("at least three independent groups are required")).cast("long")
    begin = F.when(n >= 3, train + more).otherwise(refuse)
    return begin, begin + validation + second


def shuffle_groups(samples: DataFrame, seed: int = 42) -> DataFrame:
    """Distinct groups in a seeded order, as ``(group, pos)``.

    The sort key is a uniform digest, so its first digits cut the groups into even buckets.
    """
    keyed = samples.select("group").distinct().withColumn("_key", seeded_key(seed, "group"))
    placed = with_position(keyed, [], ["_key", "group"], F.substring("_key", 1, 3))
    return placed.select("group", "pos")


def assign_groups(samples: DataFrame, seed: int = 42) -> DataFrame:
    """Split of every group. Nothing is computed before the result is; the number of groups is one row beside them."""
    groups = shuffle_groups(samples, seed)
    total = samples.agg(F.countDistinct("group").alias("_n"))
    second, third = cuts(F.col("_n"))
    split = F.when(F.col("pos") < second, SPLITS[0]).when(F.col("pos") < third, SPLITS[1]).otherwise(SPLITS[2])
    return groups.crossJoin(F.broadcast(total)).select("group", split.alias("split"))


def apply_split(samples: DataFrame, assignment: DataFrame) -> DataFrame:
    """Samples with their split; Spark broadcasts the assignment when it is small and splits
    a hot group across tasks when it is not."""
    return samples.join(assignment, "group")


def round_robin_sample(samples: DataFrame, count: int = 200, seed: int = 42, allow_short: bool = False) -> DataFrame:
    """Training frames for calibration, one per group and round, without repeated contents.

    The round of a frame is its place in its group's seeded order; a repeated content uses up
    the turn. Places come from digest buckets, so no group is sorted in one task. Fewer than ``count``
    contents are an error unless ``allow_short``.
    """
    low, high = CALIBRATION_RANGE
    if not low <= count <= high:
        raise ValueError(f"calibration needs {low} to {high} frames")
    train = samples.filter(F.col("split") == SPLITS[0]).withColumn("_key", seeded_key(seed, "image"))
    placed = with_position(train, ["group"], ["_key", "image"], F.substring("_key", 1, 4), "round")
    turn = F.struct("round", seeded_key(seed, "group").alias("group_key"), "group", "image")
    first = placed.groupBy("image_hash").agg(F.min(turn).alias("_turn"))
    chosen = first.orderBy("_turn").limit(count)
    found = chosen.agg(F.count(F.lit(1)).alias("_found"))
    short = F.raise_error(F.concat(F.lit(f"need {count} unique training images, found "), F.col("_found"))).cast("string")
    # The count stands on the left, so that an empty sample is refused as well.
    return (
        found.join(chosen, F.lit(True), "left")
        .select(
            F.when((F.col("_found") == count) | F.lit(allow_short), F.col("_turn.group")).otherwise(short).alias("group"),
            F.col("_turn.image").alias("image"),
            "image_hash",
            "_turn.round",
        )
        .filter(F.lit(not allow_short) | F.col("image_hash").isNotNull())
    )


def calibration_provenance(selected: DataFrame, count: int, seed: int, fingerprint: str) -> DataFrame:
    """Provenance row of a calibration sample; its lists hold at most ``count`` entries."""
    row = selected.agg(
        F.count(F.lit(1)).alias("count"),
        F.sort_array(F.collect_set("group")).alias("groups"),
        F.sort_array(F.collect_set("image_hash")).alias("image_hashes"),
    )
    short = F.raise_error(F.concat(F.lit(f"need {count} unique training images, found "), F.col("count")))
    return row.select(
        F.lit(SPLITS[0]).alias("split"),
        F.when(F.col("count") == count, F.col("count")).otherwise(short.cast("long")).alias("count"),
        F.lit(seed).alias("seed"),
        "groups",
        "image_hashes",
        F.lit(fingerprint).alias("dataset_fingerprint"),
    )
