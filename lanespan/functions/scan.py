"""Scans over the blocks of a key by a tree: what state does each block begin with?

A block acts on a state by its *element*. Two consecutive elements make one, so elements of ``fan`` blocks are folded into one, those again,
and so on until a key has a single group; then states go down the same groups. No row holds more than ``fan`` elements,
whatever the length of a key, and every element is written once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespan.session import materialize

FAN = 64


def block_entries(
    elements: DataFrame,
    keys: Sequence[str],
    compose: Callable[[Column, Column], Column],
    apply: Callable[[Column, Column], Column],
    start: Column,
    state_type: str,
    fan: int = FAN,
) -> DataFrame:
    """``keys, _block, _entry`` from ``keys, _block, _element`` with one row per block.

    ``compose(first, then)`` is the element of two consecutive blocks, ``apply(element, state)`` the state after a block, and
    ``start`` the state before a key's first block. A block number without a row changes nothing. One small action per
    level tells whether another is needed; a level has ``fan`` times fewer rows than the one below.
    """
    if fan < 2:
        raise ValueError("a group needs two blocks at least")
    levels, current, single = [], elements, False
    while not single:
        items = F.sort_array(F.collect_list(F.struct("_block", "_element")))
        # Every other level is shifted by one, so that blocks on both sides of number zero meet as well.
        group = F.floor((F.col("_block") + len(levels) % 2) / F.lit(fan)).cast("long")
        grouped = materialize(current.groupBy(*keys, group.alias("_group")).agg(items.alias("_items")))
        levels.append(grouped)
        single = (grouped.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= 1
        later = F.slice("_items", F.lit(2), F.size("_items"))
        whole = F.aggregate(later, F.get("_items", F.lit(0))["_element"], lambda e, i: compose(e, i["_element"]))
        current = grouped.select(*keys, F.col("_group").alias("_block"), whole.alias("_element"))
    none = F.array().cast(f"array<struct<_block:bigint,_entry:{state_type}>>")

    def enter(at: Column, item: Column) -> Column:
        here = F.array(F.struct(item["_block"].alias("_block"), at["state"].alias("_entry")))
        return F.struct(apply(item["_element"], at["state"]).alias("state"), F.concat(at["out"], here).alias("out"))

    entered = levels[-1].select(*keys, "_group", start.cast(state_type).alias("_entry"))
    for grouped in reversed(levels):
        first = F.struct(F.col("_entry").alias("state"), none.alias("out"))
        reached = F.aggregate("_items", first, enter, lambda at: at["out"])
        # explode_outer keeps the optimizer from repeating the fold in a filter below.
        each = grouped.join(entered, [*keys, "_group"]).select(*keys, F.explode_outer(reached).alias("_e"))
        entered = each.select(*keys, F.col("_e._block").alias("_group"), F.col("_e._entry").alias("_entry"))
    return entered.withColumnRenamed("_group", "_block")
