"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanespan.session import shared_folder

#: A key is hot when it holds over one row in so many; fewer keys than that can be hot.
HOT_SHARE = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and go on from the written copy: lineage ends here, executors may be lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def skew_join(rows: DataFrame, table: DataFrame, key: str, copies: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key, which says in ``copies`` how many of ``total`` rows have the key.

    Keys with more than 1/1000 of all rows are fewer than 1000, whatever the input's size; that part of the
    table is broadcast, so their rows are not gathered in one task. All other keys meet in an ordinary join.
    """
    is_hot = F.col(copies) * HOT_SHARE > F.lit(total)
    hot, cold = table.filter(is_hot), table.filter(~is_hot)
    among_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return among_hot.unionByName(others.select(among_hot.columns))


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text: first row, end row, their bytes, their offsets from 0.

    A longer row comes alone. Bounds the memory of whatever is computed per byte.
    """
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield lo, hi, whole[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi
