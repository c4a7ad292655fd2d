"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. A batch of documents is
reduced to one row per digest, a sort-merge anti-join finds the digests the index lacks, and those are appended.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanespan.llm.common import skew_join, stored

#: Characters of ``[\x20\x09-\x0D]``; equality ignores them.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _looks(n_chars: str = "n_chars", text_key: str = "text_key") -> tuple[Column, Column]:
    """Code points of ``text`` and a hash of it, blanks and all; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.length(text).cast("bigint").alias(n_chars), F.xxhash64(text).alias(text_key)


class DigestIndex:
    """Digest index at a path; opening an existing path continues it with the bucket count that is stored beside it.

    Another ``buckets`` than the stored one is an error: files of buckets that are not asked for would not be read.

    Columns: ``digest``, ``keep_id`` (document that stays for it), ``batch`` (the batch that brought it).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._stored_buckets(buckets)
        self.table = "digest_index_" + re.sub(r"\W", "_", path)[-60:] + uuid.uuid5(uuid.NAMESPACE_URL, path).hex[:12]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _stored_buckets(self, asked: int | None) -> int:
        beside = f"{self.path.rstrip('/')}-buckets"
        wanted = asked or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Written only where nothing is stored yet.
        self.spark.range(wanted, wanted + 1).coalesce(1).write.mode("ignore").parquet(beside)
        found = self.spark.read.parquet(beside).first()[0]
        if asked and asked != found:
            raise ValueError(f"the index has {found} buckets, not {asked}")
        return found

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame) -> DataFrame:
        """Append the batch's new digests; return ``doc_id, digest, keep_id, group_size, kept`` for each row of the batch.

        Of equal texts in a batch the row with most code points stays, then the smallest ``doc_id`` (null last);
        rows repeated with the same id all carry ``kept``. A digest that the index had before keeps its earlier
        document and the batch keeps none. ``group_size`` counts the batch's rows. Null text counts as empty;
        empty and blank texts are equal to each other. An empty batch gives an empty table.
        """
        return self._settled(docs).select("doc_id", "digest", "keep_id", "group_size", "kept")

    def _settled(self, docs: DataFrame) -> DataFrame:
        """What ``add`` returns, with ``n_chars, text_key`` of each row and ``stays`` for the very text that won its group."""
        batch = uuid.uuid4().hex
        rows = stored(
            docs.select(
                F.col("doc_id").cast("bigint").alias("doc_id"),
                digest(F.col("text")).alias("digest"),
                *_looks(),
            ),
            "digests",
        )
        best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key")))
        winners = stored(
            rows.groupBy("digest")
            .agg(best.alias("best"), F.count("*").alias("group_size"))
            .select("digest", F.col("best.doc_id").alias("keep_id"), "group_size", (-F.col("best.n")).alias("best_chars"), F.col("best.text_key").alias("best_key")),
            "winners",
        )
        fresh = winners.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        known = self.rows().withColumnRenamed("keep_id", "index_id")
        settled = (
            winners.hint("merge")
            .join(known, "digest")
            .select("digest", F.col("index_id").alias("keep_id"), "group_size", "best_chars", "best_key", (F.col("batch") == batch).alias("is_new"))
        )
        own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return skew_join(rows, stored(settled, "settled"), "digest", "group_size", rows.count()).select(
            "doc_id",
            "digest",
            "keep_id",
            "group_size",
            "n_chars",
            "text_key",
            (F.col("is_new") & own).alias("kept"),
            (F.col("is_new") & own & (F.col("n_chars") == F.col("best_chars")) & (F.col("text_key") == F.col("best_key"))).alias("stays"),
        )


def keep_first(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Documents of the batch that stay, with their columns; one row for each kept digest, of those with most code points."""
    kept = index._settled(docs).filter("stays").select("doc_id", "digest", "n_chars", "text_key").distinct().alias("k")
    n_chars, text_key = _looks("__n_chars", "__text_key")
    mine = docs.withColumns({"__digest": digest(F.col("text")), "__n_chars": n_chars, "__text_key": text_key}).alias("d")
    same = F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("k.doc_id")) & (F.col("d.__digest") == F.col("k.digest"))
    for name in ("n_chars", "text_key"):
        same = same & (F.col(f"d.__{name}") == F.col(f"k.{name}"))
    return mine.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__digest"]).select(*[f"`{c}`" for c in docs.columns])
