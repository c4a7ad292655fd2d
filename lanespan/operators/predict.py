"""Scoring frames with a caller-supplied predictor, batched per executor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanespan.functions.exprs import stable_sigmoid

# Names under which predictors are chosen.
BACKENDS = ("pytorch", "onnxruntime", "openvino")


def pick_backend(factories: dict[str, Callable], name: str) -> Callable:
    """Predictor factory registered under one of the known backend names."""
    if name not in BACKENDS:
        raise ValueError(f"backend must be one of {', '.join(BACKENDS)}")
    if name not in factories:
        raise ValueError(f"no predictor was supplied for {name}")
    return factories[name]


def input_fault(tensor: str, height: int, width: int, channels: int = 3):
    """A predictor accepts finite values of exactly one channels-first image."""
    values = F.col(tensor)
    return F.when(F.size(values) != channels * height * width, "shape").when(
        F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "non-finite"
    )


def score_frames(
    frames: DataFrame,
    make_predict: Callable,
    height: int,
    width: int,
    tensor: str = "tensor",
    output_kind: str = "logits",
    batch_size: int = 16,
    channels: int = 3,
    precision: str = "float",
) -> DataFrame:
    """Add the probability map ``p`` of each frame.

    ``make_predict`` loads a model once per Python worker and returns a function from an array of shape
    (n, channels, height, width) to one of shape (n, height * width). Both hold float32, or float64 with the
    ``precision`` ``double``.
    """
    if output_kind not in ("logits", "probabilities"):
        raise ValueError("output_kind must be logits or probabilities")
    if precision not in ("float", "double"):
        raise ValueError("precision must be float or double")
    kind = f"array<{precision}>"
    fault = input_fault(tensor, height, width, channels)
    checked = frames.withColumn(
        "_tensor",
        F.when(fault.isNull(), F.col(tensor).cast(kind)).otherwise(
            F.raise_error(F.concat(F.lit("bad predictor input: "), fault)).cast(kind)
        ),
    )
    run = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.FloatType() if precision == "float" else T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[channels, height, width]],
    )
    scored = checked.withColumn("p", run("_tensor").cast("array<double>")).drop("_tensor")
    if output_kind == "logits":
        scored = scored.withColumn("p", F.transform("p", stable_sigmoid))
    return scored
