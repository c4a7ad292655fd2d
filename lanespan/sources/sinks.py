"""Sinks that publish only complete and checked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanespan.functions.ordered import with_position
from lanespan.operators.audit import require_clean
from lanespan.sources import versions


def write_manifest(samples: DataFrame, path: str, require_negatives: bool = True, replaces: int = 0) -> DataFrame:
    """Write the split samples, audit what was written, then publish it as the version after ``replaces`` (0: the first).

    Readers of ``path`` never see a manifest that failed its audit, and see the version before until the new one is published.
    A manifest that is at another version, or for which another writer was first, is an error (:mod:`lanespan.sources.versions`).
    The rows are those of :func:`lanespan.sources.files.scan_manifest`, ``pos`` is the place inside the split, and the audited
    columns follow.
    """
    spark = samples.sparkSession
    versions.require_latest(spark, path, replaces)
    folder = versions.new_folder(path)
    keyed = samples.drop("pos").withColumn("_key", F.sha2(F.concat_ws("|", "group", "image", "mask"), 256))
    placed = with_position(keyed, ["split"], ["_key", "image", "mask"], F.substring("_key", 1, 4)).drop("_key")
    try:
        placed.write.json(folder)
        written = spark.read.schema(placed.schema).json(folder)
        require_clean(written, require_negatives)
        versions.publish(spark, path, folder, replaces)
    except Exception:
        versions.discard(spark, folder)
        raise
    return written


def _finite(value: Column, kind: T.DataType, name: str) -> Column:
    """The value, or an error where a number anywhere inside is NaN or infinite."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"{name} is not finite")).cast(kind)).otherwise(value)
    if isinstance(kind, T.StructType):
        inside = [_finite(value[f.name], f.dataType, f"{name}.{f.name}").alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*inside))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _finite(v, kind.elementType, f"{name}[]"))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _finite(v, kind.valueType, f"{name}{{}}"))
    return value


def write_report(report: DataFrame, path: str) -> None:
    """Write a report as JSON; NaN and infinities at any depth are refused, existing reports are kept."""
    checked = report.select(*[_finite(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in report.schema.fields])
    checked.write.mode("errorifexists").json(path)
