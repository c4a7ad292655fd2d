"""Bounded samples of labelled documents for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(parts: int, column: str = "doc_id") -> Column:
    """Remainder that decides which documents a model may learn from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


#: Bound of one text in a sample, and the pieces, spread evenly over it, to which a longer one is cut.
FIT_BYTES, FIT_PIECES = 1 << 16, 16


def bounded(text: Column) -> Column:
    """Bytes of a text that a model may learn from: all, or evenly spread pieces of a long one."""
    size = F.length(text)
    begin = [F.floor(size * (k / FIT_PIECES)).cast("int") + 1 for k in range(FIT_PIECES)]
    pieces = [F.substr(text, b, F.lit(FIT_BYTES // FIT_PIECES)) for b in begin]
    return F.when(size <= FIT_BYTES, text).otherwise(F.concat(*pieces))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, per_class: int) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """Up to ``per_class`` texts of each class, and the number of labelled documents of each class.

    Taken in the order of a hash of ``doc_id``, so that the choice does not depend on order or partitions. Held-out rows and
    rows without the label or an id are never read. Only ids are ordered; the chosen ids, at most twice ``per_class``, are
    then joined to the texts. Of rows that share an id the least text is taken, and long ones are cut to ``FIT_BYTES`` before they
    leave the executors, so the driver never holds more than that for each chosen id.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & (fold(parts) != held)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        own = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = own if chosen is None else chosen.union(own)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter(F.col("text").isNotNull())
    texts = texts.withColumn("text", bounded(F.col("text")))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [(bytes(r.text), r.y) for r in rows], counts
