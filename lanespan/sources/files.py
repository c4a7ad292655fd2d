"""Batch sources: image folders, group lists, manifests, model artifacts, frame extraction."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanespan.functions.exprs import SPLITS, is_image_path, valid_extraction_group
from lanespan.sources import versions

GROUPS_SCHEMA = "groups array<struct<group:string, images_dir:string, masks_dir:string>>"
_SAMPLES = "array<struct<image:string, mask:string, group:string>>"
MANIFEST_SCHEMA = "version bigint, splits struct<" + ", ".join(f"{s}:{_SAMPLES}" for s in SPLITS) + ">"
MANIFEST_ROWS = "split string, pos bigint, group string, image string, mask string"
_PROVENANCE = (
    "training_groups array<string>, validation_groups array<string>, training_image_hashes array<string>, "
    "validation_image_hashes array<string>, dataset_fingerprint string, provenance_complete boolean, "
    "validation_threshold double, boundary_ratio double, epoch bigint, best_validation_score double"
)
ARTIFACT_SCHEMA = (
    "architecture string, input_width int, input_height int, image_size int, roi_top double, preprocess_version int, "
    "class_names array<string>, output_kind string, model_sha256 string, "
    f"{_PROVENANCE}, quantization map<string,string>, "
    "calibration struct<split:string, count:bigint, seed:bigint, groups:array<string>, "
    "image_hashes:array<string>, dataset_fingerprint:string>"
)


def scan_image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of a folder by path; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.filter(is_image_path("path"))


def _resolve(path: Column, base: Column) -> Column:
    """Join a relative path to a folder and drop ``.`` and ``..`` steps; absolute paths stay."""
    absolute = path.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?/")
    parts = F.split(F.when(absolute, path).otherwise(F.concat_ws("/", base, path)), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc)
        .when((p == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(kept, "/")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def scan_groups(spark: SparkSession, path: str) -> DataFrame:
    """Source folders listed in a groups document, paths resolved against the document."""
    raw = spark.read.schema(GROUPS_SCHEMA).json(path, multiLine=True)
    base = _folder(F.col("_metadata.file_path"))
    rows = raw.select(base.alias("base"), F.explode("groups").alias("g")).select(
        F.col("g.group").alias("group"),
        _resolve(F.col("g.images_dir"), F.col("base")).alias("images_dir"),
        _resolve(F.col("g.masks_dir"), F.col("base")).alias("masks_dir"),
    )
    if rows.isEmpty():
        raise ValueError("the groups document needs a non-empty groups list")
    return rows


def discover_files(spark: SparkSession, groups: DataFrame) -> DataFrame:
    """Image and mask files of all listed folders as ``(group, kind, path)``.

    One file listing covers every folder; files find their group by their folder.
    """
    folders = groups.select(
        "group",
        F.explode(
            F.array(
                F.struct(F.lit("image").alias("kind"), F.col("images_dir").alias("folder")),
                F.struct(F.lit("mask").alias("kind"), F.col("masks_dir").alias("folder")),
            )
        ).alias("f"),
    ).select("group", "f.kind", "f.folder")
    # One row per source folder: a list of folder names, not of files.
    paths = [row.folder for row in folders.select("folder").distinct().collect()]
    files = spark.read.format("binaryFile").load(paths).select("path").filter(is_image_path("path"))
    return files.withColumn("folder", _folder(F.col("path"))).join(folders, "folder").select("group", "kind", "path")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a split document as ``(split, pos, group, image, mask)`` with resolved paths.

    A path that does not end in ``.json`` is a manifest written by :func:`lanespan.sources.sinks.write_manifest`: rows of
    any number instead of one document, of the version published last. Without a log it is a folder of such rows.
    """
    if not path.endswith(".json"):
        last = versions.latest(spark, path)
        rows = spark.read.schema(MANIFEST_ROWS).json(last.folder if last else path)
        known = F.when(F.col("split").isin(*SPLITS), F.col("split"))
        split = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce("split", F.lit("null")))).cast("string"))
        return _checked_samples(rows.withColumn("split", split), F.lit(None).cast("string"))
    raw = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)
    base = _folder(F.col("_metadata.file_path"))
    head = raw.select("version", *[F.col(f"splits.{s}").isNotNull().alias(s) for s in SPLITS]).first()
    keys = spark.read.json(path, multiLine=True).select("splits.*").columns
    if head is None or head.version != 1 or set(keys) != set(SPLITS) or not all(head[s] for s in SPLITS):
        raise ValueError("a manifest has version 1 and the splits train, validation and test")
    split = F.explode(
        F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"splits.{s}").alias("rows")) for s in SPLITS])
    )
    rows = raw.select(base.alias("base"), split.alias("s")).select(
        "base", "s.split", F.posexplode("s.rows").alias("pos", "r")
    )
    return _checked_samples(rows.select("split", "pos", "r.group", "r.image", "r.mask", "base"), F.col("base"))


def _checked_samples(rows: DataFrame, base: Column) -> DataFrame:
    """Samples with paths below ``base`` (null: as they are); a blank image, mask or group is an error."""
    good = F.lit(True)
    for name in ("image", "mask", "group"):
        good = good & F.coalesce(F.col(name).rlike(r"\S"), F.lit(False))
    message = F.lit("each sample needs image, mask and a non-empty group")
    place = lambda c: F.when(base.isNull(), F.col(c)).otherwise(_resolve(F.col(c), base)).alias(c)
    return rows.select(
        "split",
        "pos",
        F.when(good, F.col("group")).otherwise(F.raise_error(message).cast("string")).alias("group"),
        place("image"),
        place("mask"),
    )


#: Bytes of a file that are held at a time while its digest is taken.
PIECE = 1 << 20


def _opened(path: str):
    """A file as a stream; the local file system, HDFS, S3 and GCS are known."""
    if path.startswith("file:") or path.startswith("/"):
        return open(re.sub("^file:/+", "/", path), "rb")
    system, place = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_stream(place)


def file_digests(files: DataFrame) -> DataFrame:
    """Add ``actual_sha256`` to rows of ``path, length``. Files of any size are read in pieces where Spark put their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                with _opened(path) as stream:
                    while piece := stream.read(PIECE):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["path", "length", "actual_sha256"])

    return files.select("path", "length").mapInArrow(run, "path string, length bigint, actual_sha256 string")


def scan_artifacts(spark: SparkSession, folder: str, model_glob: str = "*.onnx") -> DataFrame:
    """Model files with the metadata beside them and the first fault found. Contents are never a column (:func:`file_digests`)."""
    digests = file_digests(spark.read.format("binaryFile").option("pathGlobFilter", model_glob).load(folder))
    sidecars = (
        spark.read.schema(ARTIFACT_SCHEMA)
        .option("pathGlobFilter", f"{model_glob}.json")
        .json(folder, multiLine=True)
        .select(F.regexp_replace("_metadata.file_path", r"\.json$", "").alias("_path"), "*")
    )
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    joined = digests.join(sidecars, plain("path") == plain("_path"), "left")
    fault = F.when(F.col("_path").isNull(), "missing sidecar").when(
        F.col("model_sha256").isNotNull() & (F.col("model_sha256") != F.col("actual_sha256")), "digest mismatch"
    )
    return joined.withColumn("fault", fault).drop("_path")


# ---------------------------------------------------------------- frame extraction


def extract_every_n(frames: DataFrame, every: int, ledger: DataFrame | None = None) -> DataFrame:
    """Every n-th frame of each source with its file name.

    Sources with an unusable name, or already in the ledger, are an error.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    if ledger is not None:
        done = frames.select("group").join(ledger.select("group"), "group", "left_semi").first()
        if done is not None:
            raise ValueError(f"group {done.group} was already extracted")
    ok = valid_extraction_group("group")
    kept = frames.filter(F.col("frame_idx") % every == 0)
    # lpad would cut indices that need more than six digits.
    digits = F.col("frame_idx").cast("string")
    padded = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    name = F.concat(F.col("group"), F.lit("_frame_"), padded)
    return kept.withColumn(
        "name", F.when(ok, name).otherwise(F.raise_error(F.lit("unusable group name")).cast("string"))
    )


def extraction_ledger(frames: DataFrame, every: int, source: str | Column = "source") -> DataFrame:
    """Frames decoded and saved per source."""
    return frames.groupBy("group").agg(
        F.lit(every).alias("every"),
        F.count(F.lit(1)).alias("frames_decoded"),
        F.count_if(F.col("frame_idx") % every == 0).alias("frames_saved"),
    )
