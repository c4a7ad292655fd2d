"""Model artifacts: metadata normalisation and provenance against the data used now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespan.session import materialize

# Fixed values of the artifact contract.
ARCHITECTURES = ("lite_road_net", "fast_scnn_lite")
OUTPUT_KINDS = ("logits", "probabilities")
CLASS_NAMES = ("background", "road")
REQUIRED_FIELDS = (
    "training_groups",
    "training_image_hashes",
    "validation_groups",
    "validation_image_hashes",
)
CALIBRATION_FIELDS = ("calibration_groups", "calibration_image_hashes")


def normalize_artifacts(raw: DataFrame) -> DataFrame:
    """Fill defaults and name the first broken rule of every artifact record.

    Old square artifacts give ``image_size``; newer ones ``input_width`` and ``input_height``.
    Columns that are not part of the contract pass through.
    """
    c = F.col
    has_w, has_h = c("input_width").isNotNull(), c("input_height").isNotNull()
    rectangular = has_w | has_h
    version = F.coalesce(c("preprocess_version"), F.when(rectangular, 1).otherwise(0))
    width = F.when(rectangular, c("input_width")).otherwise(c("image_size"))
    height = F.when(rectangular, c("input_height")).otherwise(c("image_size"))
    roi = F.coalesce(c("roi_top"), F.when(version == 1, 0.2).otherwise(0.0))
    architecture = F.coalesce(c("architecture"), F.lit(ARCHITECTURES[0]))
    kind = F.coalesce(c("output_kind"), F.lit(OUTPUT_KINDS[0]))
    names = F.coalesce(c("class_names"), F.array(*[F.lit(n) for n in CLASS_NAMES]))
    error = (
        F.when(has_w != has_h, "both input sizes required")
        .when(~version.isin(0, 1), "unsupported version")
        .when(width.isNull(), "no input size")
        .when((width < 16) | (height < 16), "input too small")
        .when((version == 1) & ((width % 16 != 0) | (height % 16 != 0)), "not a multiple of 16")
        .when((roi < 0) | (roi >= 1) | F.isnan(roi), "roi_top out of range")
        .when((version == 0) & ((roi != 0) | (width != height)), "legacy input must be square and uncropped")
        .when(~architecture.isin(*ARCHITECTURES), "unknown architecture")
        .when(~kind.isin(*OUTPUT_KINDS), "unknown output kind")
    )
    taken = {
        "input_width",
        "input_height",
        "image_size",
        "preprocess_version",
        "roi_top",
        "architecture",
        "output_kind",
        "class_names",
    }
    return raw.select(
        *[n for n in raw.columns if n not in taken],
        architecture.alias("architecture"),
        width.alias("input_width"),
        height.alias("input_height"),
        roi.cast("double").alias("roi_top"),
        version.alias("preprocess_version"),
        names.alias("class_names"),
        kind.alias("output_kind"),
        error.alias("error"),
    )


def _forbidden_fields(split: str) -> tuple[str, ...]:
    if split not in ("validation", "test"):
        raise ValueError("provenance is checked for validation or test")
    return REQUIRED_FIELDS[:2] if split == "validation" else REQUIRED_FIELDS + CALIBRATION_FIELDS


def _kind(field: Column) -> Column:
    return F.when(field.endswith("_groups"), "group").otherwise("image_hash")


def provenance_overlap(artifact_members: DataFrame, split_members: DataFrame, split: str) -> DataFrame:
    """Values of an artifact's past data that the split to be scored contains.

    ``artifact_members(artifact_id, field, value)`` lists groups and hashes in long form.
    """
    forbidden = (
        artifact_members.filter(F.col("field").isin(*_forbidden_fields(split)))
        .select("artifact_id", _kind(F.col("field")).alias("kind"), "value")
        .distinct()
    )
    current = split_members.filter(F.col("split") == split).select("kind", "value").distinct()
    return forbidden.join(current, ["kind", "value"], "left_semi").select("artifact_id", "kind", "value")


def provenance_status(
    artifacts: DataFrame,
    artifact_members: DataFrame,
    split_members: DataFrame,
    split: str,
    allow_unverified: bool = False,
) -> DataFrame:
    """Per artifact: overlap_count with the split, whether its provenance is complete, and the verdict.

    ``artifacts`` has ``artifact_id``, ``provenance_complete`` and the array ``fields`` of recorded
    field names. An overlap is leakage even when unverified artifacts are allowed.
    """
    overlap_count = provenance_overlap(artifact_members, split_members, split).groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("overlap_count")
    )
    verdict = F.when(F.col("overlap_count") > 0, "leakage").when(
        ~F.col("verified") & ~F.lit(allow_unverified), "incomplete provenance"
    )
    return (
        artifacts.join(overlap_count, "artifact_id", "left")
        .select(
            "artifact_id",
            F.coalesce("overlap_count", F.lit(0)).cast("long").alias("overlap_count"),
            complete_provenance().alias("verified"),
        )
        .withColumn("verdict", verdict)
    )


def complete_provenance() -> Column:
    required = F.array(*[F.lit(n) for n in REQUIRED_FIELDS])
    recorded = F.size(F.array_except(required, F.coalesce("fields", F.array().cast("array<string>")))) == 0
    return recorded & F.coalesce("provenance_complete", F.lit(True))


def merge_members(prior_members: DataFrame, split_members: DataFrame, artifact_id: str | None = None) -> DataFrame:
    """Members continued trainings must record: prior training data plus the current splits.

    For every artifact at once ``split_members`` has a column ``artifact_id``, the artifact that goes on with them; those without
    prior members are left out. With the argument ``artifact_id`` that one artifact goes on with all of them.
    """
    used = F.col("split").isin("train", "validation")
    prefix = F.when(F.col("split") == "train", "training").otherwise("validation")
    suffix = F.when(F.col("kind") == "group", "_groups").otherwise("_image_hashes")
    owner = F.col("artifact_id") if artifact_id is None else F.lit(artifact_id)
    current = split_members.filter(used).select(owner.alias("artifact_id"), F.concat(prefix, suffix).alias("field"), "value")
    prior = prior_members.select("artifact_id", "field", "value")
    if artifact_id is None:
        current = current.join(prior.select("artifact_id").distinct(), "artifact_id", "left_semi")
    else:
        prior = prior.filter(F.col("artifact_id") == artifact_id)
    return prior.filter(F.col("field").isin(*REQUIRED_FIELDS)).unionByName(current).distinct()


def merged_complete(prior: DataFrame | None) -> bool:
    """Complete only without a prior artifact, or with one whose own provenance is complete."""
    row = None if prior is None else prior.select(complete_provenance().alias("ok")).first()
    return True if row is None else bool(row.ok)


def ancestors(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, ancestor, depth, known`` of every artifact: itself at depth 0, the artifact it continues, and so on.

    ``artifacts`` has ``artifact_id`` and ``prior_id``. Every round extends only what the round before found, so there are as many
    rounds as the longest chain has links. ``known`` is false for a prior that the table does not have; its chain ends there. A
    chain that comes back to its start is an error.
    """
    links = artifacts.select(F.col("artifact_id").alias("_next"), F.col("prior_id").alias("_prior"), F.lit(True).alias("known"))
    found = artifacts.select("artifact_id", F.col("artifact_id").alias("ancestor"), F.lit(0).alias("depth"), F.lit(True).alias("known"))
    latest = artifacts.select("artifact_id", F.lit(0).alias("depth"), F.col("prior_id").alias("_next"))
    while True:
        step = latest.filter(F.col("_next").isNotNull()).join(links, "_next", "left")
        step = materialize(step.select("artifact_id", F.col("_next").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.coalesce("known", F.lit(False)).alias("known"), "_prior"))
        ends = step.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("ancestor") == F.col("artifact_id"), F.col("artifact_id"))).alias("loop")).first()
        if ends.loop is not None:
            raise ValueError(f"artifact {ends.loop} continues itself")
        if not ends.n:
            return found
        found = found.unionByName(step.drop("_prior"))
        latest = step.select("artifact_id", "depth", F.col("_prior").alias("_next"))


def merge_chains(artifacts: DataFrame, own_members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What every artifact of a table must record when each one continues its prior, and whether that is complete.

    ``own_members(artifact_id, field, value)`` are the groups and hashes of an artifact's own training. The first table has, for each
    artifact, those of its whole chain; the second ``artifact_id, depth, complete``: complete only if every artifact before it is
    known and has complete provenance of its own, as with :func:`complete_provenance` on ``fields`` and ``provenance_complete``.
    """
    chain = ancestors(artifacts)
    used = own_members.filter(F.col("field").isin(*REQUIRED_FIELDS)).select(F.col("artifact_id").alias("ancestor"), "field", "value")
    merged = chain.join(used, "ancestor").select("artifact_id", "field", "value").distinct()
    sound = artifacts.select(F.col("artifact_id").alias("ancestor"), complete_provenance().alias("_sound"))
    before = F.when(F.col("depth") > 0, F.col("known") & F.coalesce("_sound", F.lit(False)))
    status = chain.join(sound, "ancestor", "left").groupBy("artifact_id").agg(
        F.max("depth").alias("depth"), F.coalesce(F.min(before), F.lit(True)).alias("complete")
    )
    return merged, status
