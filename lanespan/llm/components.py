"""Connected components of an edge table by rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import skew_join, stored


def _towards_smallest(edges: DataFrame, only_smaller: bool) -> DataFrame:
    """Connect neighbours of each node to the smallest node at hand: larger ones (``only_smaller`` false) or smaller ones."""
    if only_smaller:
        ways = edges
    else:
        ways = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    ways = ways.select(F.col("high").alias("node"), F.col("low").alias("other"))
    least = stored(ways.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("least"), F.count("*").alias("ways")), "least")
    joined = skew_join(ways, least, "node", "ways", edges.count() * (1 if only_smaller else 2))
    if only_smaller:
        ends = joined.select(F.col("other").alias("high"), F.col("least").alias("low")).union(
            least.select(F.col("node").alias("high"), F.col("least").alias("low"))
        )
    else:
        ends = joined.filter(F.col("other") > F.col("node")).select(F.col("other").alias("high"), F.col("least").alias("low"))
    return ends.filter(F.col("high") != F.col("low")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge table ``high, low`` (high > low); root is the smallest node reachable.

    Larger neighbours and then smaller ones are reconnected to the smallest until every edge leads to a root. The number
    of rounds grows with the logarithm of a component's size; a node with very many edges is only ever grouped by a
    minimum, which combines on the map side, and joined by broadcast.
    """
    current = stored(edges.distinct(), "edges")
    while True:
        larger = stored(_towards_smallest(current, only_smaller=False), "edges")
        changed = stored(_towards_smallest(larger, only_smaller=True), "edges")
        same = changed.join(current, ["high", "low"], "left_semi").count()
        if same == changed.count() == current.count():
            return changed.select(F.col("high").alias("node"), F.col("low").alias("root"))
        current = changed
