"""Merkle tree of a table's records: one digest for the whole, and differences found by descending into unequal parts.

A record's place is its own digest, so trees of equal tables are equal whatever their order, files or partitions. A leaf holds the
records that share the first ``depth`` hex digits; a node above has at most 16 children. Digests spread evenly, so with the
depth of :func:`depth_for` a leaf has some dozens of distinct records and no array grows with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.functions.exprs import json_row
from lanespan.session import materialize

#: Distinct records of a leaf that a tree aims at.
LEAF = 64


def record_digests(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``digest, record, n``: every distinct record as JSON, and how often it occurs."""
    counted = df.select(json_row(list(columns)).alias("record")).groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.sha2(F.encode("record", "utf-8"), 256).alias("digest"), "record", "n")


def depth_for(records: int) -> int:
    """Hex digits after which a leaf has at most ``LEAF`` of so many distinct records on average."""
    depth = 0
    while LEAF * 16**depth < records:
        depth += 1
    return depth


def merkle_tree(records: DataFrame, depth: int) -> DataFrame:
    """``level, prefix, digest, records`` of all nodes; level 0 is the root, ``depth`` the leaves. An empty table has no nodes."""
    if not 0 <= depth < 64:
        raise ValueError("the depth must lie between 0 and 63 digits")

    def node(line):
        return F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ","), 256).alias("digest")

    line = F.concat_ws(":", "digest", F.col("n").cast("string"))
    level = records.groupBy(F.substring("digest", 1, depth).alias("prefix")).agg(node(line), F.sum("n").alias("records"))
    tree = None
    for k in range(depth, -1, -1):
        # Each level is written before the next one reads it: it has up to 16 times fewer nodes than the one below.
        level = materialize(level.select(F.lit(k).alias("level"), "prefix", "digest", "records"))
        tree = level if tree is None else tree.unionByName(level)
        line = F.concat_ws(":", "prefix", "digest")
        level = level.groupBy(F.substring("prefix", 1, k - 1).alias("prefix")).agg(node(line), F.sum("records").alias("records"))
    return tree


def unequal_nodes(left: DataFrame, right: DataFrame, depth: int) -> DataFrame:
    """``level, prefix`` of the nodes in which two trees of one depth differ; a node is looked at only if its parent differs."""
    found, parents = None, None
    for k in range(depth + 1):
        sides = []
        for tree, name in ((left, "left"), (right, "right")):
            side = tree.filter(F.col("level") == k).select("prefix", F.col("digest").alias(name))
            if parents is not None:
                own = side.withColumn("parent", F.substring("prefix", 1, k - 1))
                side = own.join(parents.select(F.col("prefix").alias("parent")), "parent", "left_semi").drop("parent")
            sides.append(side)
        both = sides[0].join(sides[1], "prefix", "full_outer")
        parents = materialize(both.filter(~F.col("left").eqNullSafe(F.col("right"))).select(F.lit(k).alias("level"), "prefix"))
        found = parents if found is None else found.unionByName(parents)
        if parents.isEmpty():
            break
    return found


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """``record, left_n, right_n`` of all records that two tables of :func:`record_digests` hold unequally often.

    Records are compared only in the leaves in which the trees differ.
    """
    left, right = materialize(left), materialize(right)
    depth = depth_for(max(left.count(), right.count()))
    nodes = unequal_nodes(merkle_tree(left, depth), merkle_tree(right, depth), depth)
    leaves = nodes.filter(F.col("level") == depth).select("prefix")
    sides = []
    for side, name in ((left, "left_n"), (right, "right_n")):
        placed = side.withColumn("prefix", F.substring("digest", 1, depth))
        sides.append(placed.join(leaves, "prefix", "left_semi").select("record", F.col("n").alias(name)))
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("left_n", "right_n")]
    return sides[0].join(sides[1], "record", "full_outer").select("record", *counts).filter("left_n <> right_n")
