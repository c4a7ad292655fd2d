"""Ordered computations per key that never put a whole key into one task.

A source may hold a third of all frames, so ``Window.partitionBy(source)`` over the frames
is avoided. Each helper cuts a key into blocks of consecutive rows, works inside the
blocks, and repairs the block borders exactly: with running totals per block (small
tables) or with a halo of copied rows from the block before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def block_of(position: str | Column, size: int = BLOCK) -> Column:
    p = F.col(position) if isinstance(position, str) else position
    return F.floor(p / F.lit(size)).cast("long")


def _before(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier blocks of the same key (block-level rows only)."""
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = "pos",
) -> DataFrame:
    """Zero-based rank of every row within its key.

    ``bucket`` must not decrease along ``order``. Only the per-bucket counts pass through a
    window over the whole key; rows are ranked inside (key, bucket) and shifted.
    """
    rows = df.withColumn("_block", bucket)
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _before(counts, keys, "_n", "_offset").drop("_n")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(inside))
    joined = ranked.join(offsets, [*keys, "_block"])
    return joined.withColumn(name, (F.col("_offset") + F.col("_rank") - 1).cast("long")).drop(
        "_offset", "_rank", "_block"
    )


def with_halo(
    df: DataFrame, keys: Sequence[str], pos: str, back: int, size: int = BLOCK
) -> tuple[DataFrame, Window, Column]:
    """Copy the last ``back`` rows of every block into the next block.

    Returns the frame with a ``_block`` column, the window over one block in position order,
    and the condition that keeps each row once. ``pos`` must be consecutive within the key;
    a window frame reaching at most ``back`` rows back then equals the one over the whole key.
    """
    if not 0 < back <= size:
        raise ValueError("the halo must be between one row and one block")
    home = block_of(pos, size)
    near_end = F.pmod(F.col(pos), F.lit(size)) >= size - back
    blocks = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_block", F.explode(blocks))
    return spread, Window.partitionBy(*keys, "_block").orderBy(pos), home == F.col("_block")


def running_total(
    df: DataFrame, keys: Sequence[str], pos: str, totals: dict[str, str], size: int | None = BLOCK
) -> DataFrame:
    """Inclusive running sums of integer columns within a key, as ``{new column: column}``.

    With ``size=None`` the rows already carry the ``_block`` column of :func:`with_halo`, and its
    partitioning is used again.
    """
    rows = df if size is None else df.withColumn("_block", block_of(pos, size))
    sums = rows.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    for n in totals:
        sums = _before(sums, keys, f"_sum_{n}", f"_before_{n}").drop(f"_sum_{n}")
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = rows.withColumns({f"_in_{n}": F.sum(c).over(inside) for n, c in totals.items()})
    joined = ranked.join(sums, [*keys, "_block"])
    shifted = joined.withColumns(
        {n: (F.col(f"_before_{n}") + F.col(f"_in_{n}")).cast("long") for n in totals}
    )
    return shifted.drop("_block", *[f"_{part}_{n}" for n in totals for part in ("in", "before")])


def even_width(df: DataFrame, column: str, rows_per_bucket: int = 1 << 16) -> int:
    """Bucket width that spreads the table over buckets of about ``rows_per_bucket`` rows.

    Reads three numbers from one column. The width only balances work; any width is exact.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or high == low:
        return 1
    return max(1, int((high - low) // max(1, n // rows_per_bucket)))
