"""Seeded augmentation plans and the image-only effects, as column expressions.

A plan is drawn per sample from digests of (seed, sample, name), so it does not depend on
partitioning or retries, and image and mask share one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespan.functions.exprs import seeded_uniform
from lanespan.operators.runs import FRAME

# Probability of each effect, parameter ranges, and the fog colours.
CHANCE = {"flip": 0.5, "crop": 0.2, "tone": 0.7, "colour": 0.35, "noise": 0.2, "fog": 0.18, "tint": 0.5, "spot": 0.15}
RANGE = {
    "crop": (0.8, 1.0),
    "gain": (0.75, 1.25),
    "offset": (-0.12, 0.12),
    "gamma": (0.7, 1.4),
    "colour": (0.85, 1.15),
    "sigma": (0.005, 0.035),
    "fog": (0.05, 0.35),
    "spot_radius": (0.1, 0.3),
    "spot_gain": (0.15, 0.6),
}
FOG_TINT = (0.75, 0.80, 0.86)
FOG_FAR, FOG_NEAR = 1.0, 0.35
EFFECTS = ("tone", "colour", "noise", "fog", "spot")


def _draw(seed: int, name: str, limits: tuple[float, float] | None = None) -> Column:
    u = seeded_uniform(seed, *FRAME, F.lit(name))
    if limits is None:
        return u
    return F.lit(limits[0]) + u * F.lit(limits[1] - limits[0])


def _happens(seed: int, name: str) -> Column:
    return _draw(seed, f"use_{name}") < CHANCE[name]


def geometric_plan(dims: DataFrame, seed: int = 42) -> DataFrame:
    """Mirror and crop decisions per frame; frames are never turned upside down."""
    c = F.col
    drawn = dims.withColumns(
        {
            "flip": _happens(seed, "flip"),
            "crop": _happens(seed, "crop") & (F.least("height", "width") > 4),
            "_f": _draw(seed, "crop_fraction", RANGE["crop"]),
        }
    )
    sized = drawn.withColumns(
        {
            "crop_h": F.greatest(F.lit(1), (c("height") * c("_f")).cast("int")),
            "crop_w": F.greatest(F.lit(1), (c("width") * c("_f")).cast("int")),
        }
    )
    return sized.withColumns(
        {
            "crop_top": F.floor(_draw(seed, "crop_top") * (c("height") - c("crop_h") + 1)).cast("int"),
            "crop_left": F.floor(_draw(seed, "crop_left") * (c("width") - c("crop_w") + 1)).cast("int"),
        }
    ).drop("_f")


def photometric_plan(frames: DataFrame, seed: int = 42, effects: Sequence[str] = EFFECTS) -> DataFrame:
    """Effect parameters per frame; an effect that does not happen gets its neutral value."""
    def pick(effect: str, value: Column, neutral: float) -> Column:
        if effect not in effects:
            return F.lit(neutral)
        return F.when(_happens(seed, effect), value).otherwise(F.lit(neutral))

    def ranged(name: str, part: str = "") -> Column:
        return _draw(seed, name + part, RANGE[name])

    tinted = _happens(seed, "tint")
    return frames.withColumns(
        {
            "gain": pick("tone", ranged("gain"), 1.0),
            "offset": pick("tone", ranged("offset"), 0.0),
            "gamma": pick("tone", ranged("gamma"), 1.0),
            "colour": F.array(*[pick("colour", ranged("colour", str(i)), 1.0) for i in range(3)]),
            "sigma": pick("noise", ranged("sigma"), 0.0),
            "fog": pick("fog", ranged("fog"), 0.0),
            "tint": F.array(*[F.when(tinted, F.lit(t)).otherwise(1.0) for t in FOG_TINT]),
            "spot_gain": pick("spot", ranged("spot_gain"), 0.0),
            "spot_x": _draw(seed, "spot_x") * F.col("width"),
            "spot_y": _draw(seed, "spot_y") * F.col("height"),
            "spot_radius": F.greatest("height", "width") * ranged("spot_radius"),
        }
    )


def photometric_augment(frames: DataFrame, seed: int = 42, effects: Sequence[str] = EFFECTS) -> DataFrame:
    """Brightness, gamma, colour, noise, fog and light spot on ``pixels`` (0..255, row-major,
    channels interleaved). One pass over the array per frame, no explode."""
    c = F.col
    planned = photometric_plan(frames, seed, effects)
    names = [n for n in planned.columns if n not in frames.columns]
    rows = F.greatest(c("height") - 1, F.lit(1))

    def pixel(v: Column, i: Column, plan: Column) -> Column:
        channel = i % c("channels")
        x = F.floor(i / c("channels")) % c("width")
        y = F.floor(i / (c("channels") * c("width")))
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / 255.0 * plan["gain"] + plan["offset"]))
        value = F.pow(value, plan["gamma"])
        if "colour" in effects:
            value = value * F.get(plan["colour"], channel % 3)
        if "noise" in effects:
            value = value + plan["sigma"] * _normal(seed, i)
        if "fog" in effects:
            haze = plan["fog"] * (FOG_FAR + (FOG_NEAR - FOG_FAR) * y / rows)
            value = value * (1 - haze) + F.get(plan["tint"], channel % 3) * haze
        if "spot" in effects:
            away = F.pow(x - plan["spot_x"], 2) + F.pow(y - plan["spot_y"], 2)
            value = value + plan["spot_gain"] * F.exp(-away / (2 * F.pow(plan["spot_radius"], 2)))
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * 255).cast("int")

    # The plan enters as the element of a one-item array: it is drawn once per frame, whereas
    # plain columns would be merged into the lambda and drawn again for every pixel.
    augmented = F.transform(
        F.array(F.struct(*names)), lambda plan: F.transform("pixels", lambda v, i: pixel(v, i, plan))
    )
    return planned.select(*frames.columns, F.get(augmented, F.lit(0)).alias("augmented"))


def _normal(seed: int, i: Column) -> Column:
    """Standard normal number per pixel from two hashed uniforms."""
    def uniform(name: str) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(name), F.col(FRAME[0]), F.col(FRAME[1]), i)
        return (F.pmod(h, F.lit(1 << 31)) + 0.5) / float(1 << 31)

    return F.sqrt(-2 * F.log(uniform("radius"))) * F.cos(F.lit(6.283185307179586) * uniform("angle"))
