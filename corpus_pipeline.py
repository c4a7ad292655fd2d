"""Corpus pipeline: rejected documents go, then copies, then near copies, then benchmark passages; the rest is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the last return the columns of
``docs``. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanespan.llm import bpe, decontaminate, exact_dedup, quality, simhash
from lanespan.llm.common import documents, stored
from lanespan.llm.queries import benchmark_items, labels
from lanespan.session import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for blanks."""
    return exact_dedup.keep_first(docs, exact_dedup.DigestIndex(spark, shared_folder(spark, "digest-index")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.decontaminate(docs, benchmark_items(spark, sf_dir))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document that is left, as counts and digests."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("encode", encode_stage),
]
#: A trained network and 64-bit hashes are beyond SQL; tests hold the rows against plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
