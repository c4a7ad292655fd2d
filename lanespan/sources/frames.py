"""Continuous sources: ordered frames arriving as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream_frames(
    spark: SparkSession,
    schema: T.StructType | str,
    path: str,
    file_format: str = "parquet",
    files_per_trigger: int = 16,
) -> DataFrame:
    """Frames appended to a folder, a bounded number of files per micro-batch."""
    reader = (
        spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    )
    return reader.load(path)
