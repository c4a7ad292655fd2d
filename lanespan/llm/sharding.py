"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions alone.

The ring has a fixed number of places. Each shard stands at several of them; a text belongs to the next shard clockwise from
the place of its hash, so equal texts go together. A shard takes the rows at home there, in ring order, up to its bound; rows
beyond it queue up and go on clockwise to the next shards that have room. The bounds add up to the number of rows and
differ by one at most, so the shards' counts do too, however skewed the texts are.

Ranks come from counts: of lanes (a few per place, by a hash of the id, so that a text with very many copies is not
one group), of places and of virtual nodes. These tables have a fixed largest size; only ranks inside a lane need rows in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanespan.llm.common import stored

SHARDS, NODES = 24, 64
PLACES, LANES = 1 << 16, 64
#: Steps of the table that leads from a rank in the queue to the shard with room for it.
STEPS = 4096


def ring(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """Every place of the ring: ``place, turn`` (its position clockwise), ``arc, shard`` of the next virtual node."""
    shard = (F.col("id") % shards).cast("int")
    node = spark.range(shards * nodes).select(F.pmod(F.xxhash64(shard, (F.col("id") / shards).cast("int")), F.lit(PLACES)).cast("int").alias("at"), shard.alias("shard"))
    one = node.groupBy("at").agg(F.min("shard").alias("shard")).agg(F.sort_array(F.collect_list(F.struct("at", "shard"))).alias("all"))
    arcs = one.select("all", F.posexplode("all").alias("arc", "node"))
    # The first arc begins after the last node, on the far side of place 0.
    last = F.element_at("all", -1)["at"] - PLACES
    begin = F.when(F.col("arc") == 0, last).otherwise(F.get("all", F.col("arc") - 1)["at"]) + 1
    turns = arcs.select("arc", F.col("node.shard").alias("shard"), F.explode(F.sequence(begin, F.col("node.at"))).alias("turn"))
    return turns.withColumn("place", F.pmod("turn", F.lit(PLACES)))


def _room(places: DataFrame, arcs: DataFrame, shards: int, bound) -> DataFrame:
    """Where the queue goes: ``begin, taken`` (ranks in the queue), ``to`` (shard) and ``slot`` (of the first one there).

    One fold over the virtual nodes, twice around; the array has as many entries as the ring has nodes.
    """
    loads = places.groupBy("shard").agg(F.sum("n").alias("load"))
    every = arcs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(loads, "shard", "left")
    spare = F.greatest(bound(F.col("shard")) - F.coalesce("load", F.lit(0)), F.lit(0)).cast("bigint")
    spare = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", spare.alias("spare")))), lambda s: s["spare"]).alias("spare"))
    queued = places.groupBy("arc").agg(F.sum("over").alias("over"))
    walk = arcs.join(queued, "arc", "left").agg(
        F.sort_array(F.collect_list(F.struct("arc", "shard", F.coalesce("over", F.lit(0)).cast("bigint").alias("over")))).alias("walk")
    )
    again = F.transform("walk", lambda n: F.struct(n["arc"].alias("arc"), n["shard"].alias("shard"), F.lit(0).cast("bigint").alias("over")))
    steps = F.concat("walk", again)
    start = F.struct(
        F.lit(0).cast("bigint").alias("queue"),
        F.lit(0).cast("bigint").alias("placed"),
        F.col("spare").alias("spare"),
        F.array().cast("array<struct<begin:bigint,taken:bigint,to:int,slot:bigint>>").alias("out"),
    )

    def visit(state, node):
        room = F.get(state["spare"], node["shard"])
        taken = F.least(state["queue"] + node["over"], room)
        entry = F.struct(
            state["placed"].alias("begin"), taken.alias("taken"), node["shard"].alias("to"), (bound(node["shard"]) - room).cast("bigint").alias("slot")
        )
        return F.struct(
            (state["queue"] + node["over"] - taken).alias("queue"),
            (state["placed"] + taken).alias("placed"),
            F.transform(state["spare"], lambda v, k: F.when(k == node["shard"], v - taken).otherwise(v)).alias("spare"),
            F.when(taken > 0, F.concat(state["out"], F.array(entry))).otherwise(state["out"]).alias("out"),
        )

    return walk.crossJoin(spare).select(F.explode(F.aggregate(steps, start, visit)["out"]).alias("e")).select("e.*")


def shard(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the law is ``rows``.

    Null text counts as empty (size 8, checksum 0). Rows repeated in full are placed one by one. With fewer rows than
    shards some shards stay empty. Which of two rows with the same id and text gets which slot is left open.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 8).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(PLACES)).cast("int").alias("place"),
            F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))), F.lit(LANES)).cast("int").alias("lane"),
        ),
        "rows",
    )
    total = rows.count()

    def bound(s):
        return F.lit(total // shards) + (s < total % shards).cast("int")

    around = stored(ring(spark, shards, nodes), "ring")
    cells = stored(rows.groupBy("place", "lane").agg(F.count("*").alias("n")), "cells")
    home = Window.partitionBy("shard").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    clockwise = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("arc").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    places = cells.groupBy("place").agg(F.sum("n").alias("n")).join(around, "place").withColumn("before", F.coalesce(F.sum("n").over(home), zero))
    stays = F.greatest(F.least(F.col("n"), bound(F.col("shard")) - F.col("before")), zero)
    places = stored(places.withColumn("stays", stays.cast("bigint")).withColumn("over", F.col("n") - F.col("stays")), "places")
    # Ranks in the queue: arcs first (as many as nodes), then the places of an arc.
    arc_over = places.groupBy("arc").agg(F.sum("over").alias("arc_over")).withColumn("arc_queue", F.coalesce(F.sum("arc_over").over(clockwise), zero))
    queued = places.join(arc_over.select("arc", "arc_queue"), "arc").withColumn(
        "queue", F.col("arc_queue") + F.coalesce(F.sum("over").over(inside), zero)
    )
    room = _room(places, around.select("arc", "shard").distinct(), shards, bound)
    waiting = places.agg(F.coalesce(F.sum("over"), zero)).first()[0]
    width = waiting // STEPS + 1
    steps = F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("begin") + F.col("taken") - 1) / width)))
    lookup = stored(room.withColumn("step", steps), "room")
    lane_order = Window.partitionBy("place").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("place", "lane", F.coalesce(F.sum("n").over(lane_order), zero).alias("lane_before"))
    cells = cells.join(queued.select("place", "shard", "before", "stays", "queue"), "place")
    in_lane = Window.partitionBy("place", "lane").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(in_lane) - 1).join(cells, ["place", "lane"]).withColumn("rank", F.col("rank") + F.col("lane_before"))
    at = F.when(F.col("rank") >= F.col("stays"), F.col("queue") + F.col("rank") - F.col("stays"))
    ranked = ranked.withColumn("at", at).withColumn("step", F.floor(F.col("at") / width)).alias("r")
    way = F.broadcast(lookup).alias("w")
    meets = (F.col("r.step") == F.col("w.step")) & (F.col("r.at") >= F.col("w.begin")) & (F.col("r.at") < F.col("w.begin") + F.col("w.taken"))
    return ranked.join(way, meets, "left").select(
        "doc_id",
        F.col("r.size").alias("size"),
        "text_crc32",
        F.lit("rows").alias("law"),
        F.coalesce("to", "shard").alias("shard"),
        F.when(F.col("at").isNull(), F.col("before") + F.col("rank")).otherwise(F.col("w.slot") + F.col("at") - F.col("w.begin")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
