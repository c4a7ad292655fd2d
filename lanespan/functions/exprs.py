"""Scalar column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions, split names and stage names a job must agree on.
IMAGE_EXTENSIONS = ("bmp", "jpeg", "jpg", "png", "tif", "tiff")
SPLITS = ("train", "validation", "test")
STAGES = ("read", "prepare", "inference", "temporal", "geometry", "render", "write", "total")


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def file_name(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def is_image_path(path: str | Column) -> Column:
    """True for the accepted image extensions, whatever their case."""
    extension = F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))
    return extension.isin(*IMAGE_EXTENSIONS)


def file_stem(path: str | Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def mask_stem(path: str | Column) -> Column:
    """Stem under which a mask pairs with its image: one trailing ``_mask`` is ignored."""
    return F.regexp_replace(file_stem(path), r"_mask$", "")


def valid_extraction_group(group: str | Column) -> Column:
    """Letters, digits, underscore, dot and hyphen only, and not a directory reference."""
    g = col(group)
    return F.coalesce(g.rlike(r"(?U)^[\w.-]+\z") & ~g.isin(".", ".."), F.lit(False))


def valid_manifest_group(group: str | Column) -> Column:
    """Any text that is more than white space."""
    return F.coalesce(col(group).rlike(r"(?U)\S"), F.lit(False))


def shape_text(*dims: str | Column) -> Column:
    """Array shape as written in front of the hashed bytes, e.g. ``(48, 80, 3)``."""
    return F.concat(F.lit("("), F.concat_ws(", ", *[col(d).cast("string") for d in dims]), F.lit(")"))


def content_digest(pixels: str | Column, *dims: str | Column) -> Column:
    """SHA-256 of shape and decoded bytes, so a re-encoded copy keeps its digest."""
    data = F.concat(F.encode(shape_text(*dims), "utf-8"), col(pixels).cast("binary"))
    return F.sha2(data, 256)


def stable_sigmoid(logit: str | Column) -> Column:
    x = col(logit)
    decay = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + decay)).otherwise(decay / (1 + decay))


def sigmoid_array(logits: str | Column) -> Column:
    return F.transform(col(logits), stable_sigmoid)


def ratio_or_one(numerator: str | Column, denominator: str | Column) -> Column:
    """Overlap ratio where nothing-versus-nothing counts as full agreement."""
    d = col(denominator)
    return F.when(d == 0, F.lit(1.0)).otherwise(col(numerator) / d)


def ratio_or_null(numerator: str | Column, denominator: str | Column) -> Column:
    return col(numerator) / F.nullif(col(denominator), F.lit(0))


def half_even(value: str | Column) -> Column:
    """Round a double to the nearest integer, ties to even."""
    return F.rint(col(value)).cast("int")


def percent_of(size: str | Column, share: float) -> Column:
    """``int(size * share)`` in double arithmetic, truncating."""
    return (col(size).cast("double") * F.lit(float(share))).cast("int")


def probability_fault(p: str | Column, height: str | Column, width: str | Column) -> Column:
    """Null for a clean map, otherwise the first fault found."""
    values = col(p)
    bad_number = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        F.when(values.isNull() | (F.size(values) != col(height) * col(width)), "shape")
        .when(bad_number, "non-finite")
        .when(F.exists(values, lambda v: (v < 0) | (v > 1)), "range")
    )


def seeded_key(seed: int | str, *parts: str | Column) -> Column:
    """Reproducible pseudo-random sort key (64 uniform hex digits) for a row."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]), 256)


def seeded_uniform(seed: int | str, *parts: str | Column) -> Column:
    """Reproducible uniform number in [0, 1) for a row."""
    digits = F.substring(seeded_key(seed, *parts), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def json_text(value: str | Column) -> Column:
    """JSON string literal with everything outside printable ASCII escaped per UTF-16 unit."""
    s = col(value)
    units = F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))

    def escape(unit: Column) -> Column:
        code = F.conv(unit, 16, 10).cast("int")
        return (
            F.when(code == 0x22, '\\"')
            .when(code == 0x5C, "\\\\")
            .when(code == 0x0A, "\\n")
            .when(code == 0x0D, "\\r")
            .when(code == 0x09, "\\t")
            .when(code == 0x08, "\\b")
            .when(code == 0x0C, "\\f")
            .when((code >= 0x20) & (code <= 0x7E), F.chr(code))
            .otherwise(F.concat(F.lit("\\u"), F.lower(unit)))
        )

    plain = s.rlike(r"\A[ !#-\[\]-~]*\z")
    body = F.when(plain, s).otherwise(F.array_join(F.transform(units, escape), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_row(values: Sequence[str | Column]) -> Column:
    """JSON list of string literals with ``", "`` between items."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[json_text(v) for v in values]), F.lit("]"))


def letterbox_plan(
    height: str | Column,
    width: str | Column,
    input_width: int,
    input_height: int,
    roi_top: float = 0.20,
    preprocess_version: int = 1,
) -> Column:
    """Struct describing how a frame is cropped, scaled and centred on the model canvas."""
    check_input_size(input_width, input_height, roi_top, preprocess_version)
    h, w = col(height).cast("int"), col(width).cast("int")
    roi_y = F.least(h - 1, percent_of(h, roi_top))
    roi_h = h - roi_y
    if preprocess_version == 0:
        content_w, content_h = F.lit(input_width), F.lit(input_height)
    else:
        scale = F.least(F.lit(float(input_width)) / w, F.lit(float(input_height)) / roi_h)
        content_w = F.greatest(F.lit(1), F.least(F.lit(input_width), half_even(w * scale)))
        content_h = F.greatest(F.lit(1), F.least(F.lit(input_height), half_even(roi_h * scale)))
    return F.struct(
        h.alias("original_height"),
        w.alias("original_width"),
        roi_y.alias("roi_y"),
        F.lit(input_width).alias("input_width"),
        F.lit(input_height).alias("input_height"),
        F.floor((F.lit(input_width) - content_w) / 2).cast("int").alias("left"),
        F.floor((F.lit(input_height) - content_h) / 2).cast("int").alias("top"),
        content_w.cast("int").alias("content_width"),
        content_h.cast("int").alias("content_height"),
    )


def check_input_size(width: int, height: int, roi_top: float, version: int) -> None:
    if version not in (0, 1):
        raise ValueError("unsupported preprocess version")
    step = 16 if version == 1 else 1
    if min(width, height) < 16 or width % step or height % step:
        raise ValueError("input sizes must be at least 16 and, in version 1, multiples of 16")
    if not 0 <= roi_top < 1:
        raise ValueError("roi_top must lie in [0, 1)")
    if version == 0 and roi_top != 0:
        raise ValueError("version 0 stretches the whole frame and needs roi_top=0")
