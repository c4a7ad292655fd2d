"""Admission rules of live sources: cameras drop old frames, files lose nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lanespan.operators.telemetry import dropped_frames, latest_frames


def camera_intake(frames: DataFrame, kept_path: str, ledger_path: str, checkpoint: str, queue_size: int = 2) -> DataStreamWriter:
    """Per micro-batch and source keep only the newest frames and note how many were dropped.

    Output folders are written per batch id, so a repeated batch replaces its own files.
    """

    def admit(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            latest_frames(batch, queue_size).write.mode("overwrite").parquet(f"{kept_path}/batch={batch_id}")
            dropped_frames(batch, queue_size).write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return frames.writeStream.foreachBatch(admit).option("checkpointLocation", checkpoint)


def camera_totals(kept: DataFrame, ledger: DataFrame, queue_size: int = 2) -> DataFrame:
    """Frames read, left in the queue and dropped per source when nothing was taken from it meanwhile, and the newest frame.

    The newest of all are among the newest of each micro-batch, so the result does not depend on their borders.
    """
    newest = latest_frames(kept, queue_size).groupBy("group").agg(F.max("frame_idx").alias("newest"), F.count("*").alias("frames_processed"))
    read = ledger.groupBy("group").agg(F.sum("frames_read").alias("frames_read"))
    joined = read.join(newest, "group")
    return joined.withColumn("frames_dropped", F.col("frames_read") - F.col("frames_processed"))


def lossless_intake(frames: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Every frame of a file source exactly once; the index column keeps the order."""
    return (
        frames.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def run_to_end(writer: DataStreamWriter) -> None:
    """Process what is available now and stop."""
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
