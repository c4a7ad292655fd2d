"""Dataset audit: pairing, faults, leakage, summaries and content fingerprints.

Everything is a keyed aggregate with map-side combine. Lists of groups and hashes are kept as
long tables, because a split may hold any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespan.functions.exprs import SPLITS, file_stem, json_row, mask_stem


def pair_images_masks(files: DataFrame) -> DataFrame:
    """Match image and mask files of a group by stem.

    ``files(group, kind, path)`` has ``kind`` image or mask. One aggregate replaces the full
    outer join: it yields the pair, its counts and the first fault.
    """
    image = F.col("kind") == "image"
    keyed = files.withColumn("stem", F.when(image, file_stem("path")).otherwise(mask_stem("path")))
    pairs = keyed.groupBy("group", "stem").agg(
        F.count_if(image).alias("images"),
        F.count_if(~image).alias("masks"),
        F.min(F.when(image, F.col("path"))).alias("image"),
        F.min(F.when(~image, F.col("path"))).alias("mask"),
    )
    fault = (
        F.when(F.col("masks") > 1, "ambiguous mask")
        .when(F.col("images") > 1, "duplicate image")
        .when(F.col("masks") == 0, "missing mask")
        .when(F.col("images") == 0, "orphan mask")
    )
    return pairs.withColumn("fault", fault)


def missing_masks(files: DataFrame) -> DataFrame:
    return pair_images_masks(files).filter("masks = 0").select("group", "stem", "image")


def orphan_masks(files: DataFrame) -> DataFrame:
    return pair_images_masks(files).filter("images = 0").select("group", "stem", "mask")


def samples_of(pairs: DataFrame) -> DataFrame:
    """Sample records of the clean pairs."""
    return pairs.filter(F.col("fault").isNull()).select("group", "image", "mask")


def pair_fault() -> Column:
    """First fault of an inspected pair, in the order in which a reader meets them."""
    c = F.col
    values = F.array_distinct(c("mask_values"))
    binary = (F.size(F.array_except(values, F.array(F.lit(0), F.lit(1)))) == 0) | (
        F.size(F.array_except(values, F.array(F.lit(0), F.lit(255)))) == 0
    )
    return (
        F.when(~c("mask_exists"), "missing file")
        .when(~c("readable"), "unreadable")
        .when(c("channels") != 1, "not single-channel")
        .when((c("height") != c("mask_height")) | (c("width") != c("mask_width")), "size mismatch")
        .when(~binary, "non-binary")
    )


def pair_faults(facts: DataFrame) -> DataFrame:
    return facts.select("image", "mask", pair_fault().alias("fault")).filter(F.col("fault").isNotNull())


# ---------------------------------------------------------------- audit of a split manifest


def split_audit(samples: DataFrame) -> DataFrame:
    """Samples, groups, road-free frames and distinct contents per split, with a verdict."""
    names = F.explode(F.array(*[F.lit(s) for s in SPLITS])).alias("split")
    all_splits = samples.sparkSession.range(1).select(names)
    counted = samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.countDistinct("group").alias("groups"),
        F.count_if("negative").alias("negative_frames"),
        F.countDistinct("image_hash").alias("image_hashes"),
    )
    filled = all_splits.join(counted, "split", "left").select(
        "split",
        *[
            F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
            for c in ("samples", "groups", "negative_frames", "image_hashes")
        ],
    )
    fault = F.when(F.col("samples") == 0, "empty split").when(
        F.col("negative_frames") == 0, "no negative frames"
    )
    return filled.withColumn("fault", fault)


def split_members(samples: DataFrame, *keys: str) -> DataFrame:
    """The groups and image hashes of every split, one row each; with ``keys``, of every split of each key."""
    members = F.explode(
        F.array(
            F.struct(F.lit("group").alias("kind"), F.col("group").alias("value")),
            F.struct(F.lit("image_hash").alias("kind"), F.col("image_hash").alias("value")),
        )
    )
    return samples.select(*keys, "split", members.alias("_m")).select(*keys, "split", "_m.kind", "_m.value").distinct()


def _in_several_splits(samples: DataFrame, key: str) -> DataFrame:
    spread = samples.groupBy(key).agg(
        F.min("split").alias("first_split"), F.max("split").alias("last_split"), F.count(F.lit(1)).alias("samples")
    )
    return spread.filter(F.col("first_split") != F.col("last_split"))


def group_leakage(samples: DataFrame) -> DataFrame:
    """Groups that occur in more than one split."""
    return _in_several_splits(samples, "group")


def content_leakage(samples: DataFrame) -> DataFrame:
    """Image contents that occur in more than one split; copies inside a split are allowed."""
    return _in_several_splits(samples, "image_hash")


def path_reuse(samples: DataFrame) -> DataFrame:
    """Paths used more than once, images and masks sharing one name space."""
    paths = samples.select(F.explode(F.array("image", "mask")).alias("path"))
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")


def split_intersection(members: DataFrame, left: str, right: str) -> DataFrame:
    """Groups and hashes present in both of two splits."""
    part = lambda s: members.filter(F.col("split") == s).select("kind", "value")
    return part(left).intersect(part(right))


def require_clean(samples: DataFrame, require_negatives: bool = True) -> None:
    """Raise on the first audit rule a manifest breaks. Each check returns at most one row."""
    checks = [
        ("group leakage", group_leakage(samples)),
        ("overlapping sample path", path_reuse(samples)),
        ("content leakage", content_leakage(samples)),
        ("unknown split", samples.filter(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)))),
        ("blank group", samples.filter(~F.coalesce(F.col("group").rlike(r"(?U)\S"), F.lit(False)))),
    ]
    for name, rows in checks:
        hit = rows.first()
        if hit is not None:
            raise ValueError(f"{name}: {hit[0]}")
    for row in split_audit(samples).collect():
        if row.fault == "empty split" or (row.fault and require_negatives):
            raise ValueError(f"{row.split}: {row.fault}")


# ---------------------------------------------------------------- fingerprints

def _record() -> Column:
    return json_row(["split", "group", "image_hash", "mask_hash"])


def dataset_digest(samples: DataFrame) -> DataFrame:
    """Order-independent content digest for manifests of any size.

    Equal records are counted first; records are hashed into 65,536 buckets by their own
    digest, every bucket is hashed in sorted order, and so is the list of bucket digests.
    """
    counted = samples.groupBy(F.sha2(F.encode(_record(), "utf-8"), 256).alias("r")).agg(
        F.count(F.lit(1)).alias("n")
    )
    line = F.concat_ws(":", "r", F.col("n").cast("string"))
    buckets = counted.groupBy(F.substring("r", 1, 4).alias("b")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ","), 256).alias("h"), F.sum("n").alias("n")
    )
    pieces = F.sort_array(F.collect_list(F.concat_ws(":", "b", "h")))
    return buckets.agg(
        F.sum("n").alias("records"), F.sha2(F.array_join(pieces, ","), 256).alias("dataset_digest")
    )
