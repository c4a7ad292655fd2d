"""Exact interpolated percentiles by repeated selection: count in buckets, keep the ones that hold a wanted rank, cut those again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanespan.session import materialize

#: Buckets into which a key's range is cut at a time, and the rows of a bucket that are few enough to be ordered by one task.
BUCKETS, SMALL = 1024, 1 << 16
#: Selected ranges that may be broadcast; beyond that they are joined, each in so many parts that a hot key is many tasks.
BROADCAST_ROWS, SALTS = 100_000, 32


def _bucket(value: Column, low: Column, high: Column) -> Column:
    """Bucket of a value within a range; it never falls as the value grows, whatever is rounded.

    The ends have buckets of their own, so that a range always gets smaller; halves keep the differences finite.
    """
    inner = F.floor((value / 2 - low / 2) / (high / 2 - low / 2) * (BUCKETS - 2))
    finite = (F.abs(low) < float("inf")) & (F.abs(high) < float("inf")) & ~F.isnan(high)
    place = F.when(finite, F.least(F.greatest(inner, F.lit(0)), F.lit(BUCKETS - 3)) + 1).otherwise(1)
    return F.when(value == low, 0).when(value == high, BUCKETS - 1).otherwise(place).cast("int")


def _inside(rows: DataFrame, ranges: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Rows whose value lies in a range of their key; ranges of a key do not overlap."""
    within = (F.col("_value") >= F.col("_low")) & (F.col("_value") <= F.col("_high"))
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ranges), keys).filter(within)
    salted = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("_value"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [*keys, "_salt"]).filter(within).drop("_salt")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """One row per key with its count, mean, and an interpolated percentile per entry of ``probabilities``.

    A key's range is cut into buckets whose counts are exact; a bucket that holds a wanted rank becomes a range of its own and is
    cut again as long as it has more than ``SMALL`` rows and more than one value. Rows are counted where they are and only counts are
    shuffled; what is ordered in the end is never more than ``SMALL`` rows a task, and a key that holds most rows is many tasks.
    Each level costs one pass and one small action. Nulls do not count; without keys an empty table has one
    row, with no rows counted and nulls.
    """
    own = list(keys) or ["_all"]
    rows = df.filter(F.col(value).isNotNull())
    rows = rows.select(*([F.col(k) for k in keys] or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_value"))
    whole = [F.count(F.lit(1)).alias("n"), F.avg("_value").alias("mean"), F.min("_value").alias("_low"), F.max("_value").alias("_high")]
    totals = materialize(rows.groupBy(*own).agg(*whole) if keys else rows.agg(*whole).withColumn("_all", F.lit(0)))

    def rank(p: float) -> Column:
        return F.lit(float(p)) * (F.col("n") - 1)

    wanted = [r for p in probabilities.values() for r in (F.floor(rank(p)), F.ceil(rank(p)))]
    ranges = totals.select(*own, "n", "_low", "_high", F.lit(0).cast("long").alias("_start"), F.col("n").alias("_size"))
    settled: list[DataFrame] = []
    large = (F.col("_size") > SMALL) & (F.col("_low") != F.col("_high"))
    while True:
        pending = ranges.filter(large)
        count = pending.count()
        settled.append(ranges.filter(~large))
        if not count:
            break
        counted = (
            _inside(rows, pending, own, count)
            .groupBy(*own, "n", "_start", _bucket(F.col("_value"), F.col("_low"), F.col("_high")).alias("_bucket"))
            .agg(F.count(F.lit(1)).alias("_size"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
        )
        past = Window.partitionBy(*own, "_start").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_size").over(past), F.lit(0)))
        hit = F.lit(False)
        for r in wanted:
            hit = hit | ((r >= F.col("_start")) & (r < F.col("_start") + F.col("_size")))
        ranges = materialize(placed.filter(hit).drop("_bucket"))
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    single = found.filter("_low = _high").select(*own, "_start", "_size", F.col("_low").alias("_at"))
    few = found.filter("_low <> _high")
    equal = _inside(rows, few, own, few.count()).groupBy(*own, "_start", "_value").agg(F.count(F.lit(1)).alias("_size"))
    past = Window.partitionBy(*own, "_start").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    ordered = equal.select(
        *own, (F.col("_start") + F.coalesce(F.sum("_size").over(past), F.lit(0))).alias("_start"), "_size", F.col("_value").alias("_at")
    )

    def at(position: Column) -> Column:
        return F.max(F.when((position >= F.col("_start")) & (position < F.col("_start") + F.col("_size")), F.col("_at")))

    picked, results = [], []
    for name, p in probabilities.items():
        picked += [at(F.floor(rank(p))).alias(f"_lo_{name}"), at(F.ceil(rank(p))).alias(f"_hi_{name}")]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        fraction = rank(p) - F.floor(rank(p))
        results.append((lo + (hi - lo) * fraction).alias(name))
    values = single.unionByName(ordered).join(totals.select(*own, "n"), own)
    ranks = values.groupBy(*own, "n").agg(*picked).select(*own, *results)
    return totals.select(*own, "n", "mean").join(ranks, own, "left").select(*keys, "n", "mean", *probabilities)
