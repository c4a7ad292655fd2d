"""Session helpers: a local session for tests and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", memory: str = "12g") -> SparkSession:
    """Session used by the tests and the benchmark; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lanespan")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_base(spark: SparkSession) -> str:
    """Shared storage of the cluster, as named in ``spark.checkpoint.dir``.

    Only a session on one machine (``local``) may lack that setting and gets a temporary folder; a cluster's executors
    and driver do not see each other's.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables a job writes and reads back."""
    return f"{_shared_base(spark)}/lanespan/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, and continue from the written copy; it is computed once."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
