"""The tree scan against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lanespan.functions.scan import block_entries


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_entries_equal_a_loop(spark, fan):
    """Each block maps a number x to a * x + b; maps compose and do not commute."""
    rng = random.Random(fan)
    rows = [(k, b, rng.randint(-2, 2), rng.randint(-5, 5)) for k, n in (("a", 40), ("b", 1), ("c", 7)) for b in range(-3, n - 3) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "key string, _block bigint, a bigint, b bigint")
    elements = df.select("key", "_block", F.struct("a", "b").alias("_element"))

    def compose(first, then):
        return F.struct((first["a"] * then["a"]).alias("a"), (first["b"] * then["a"] + then["b"]).alias("b"))

    entries = block_entries(elements, ["key"], compose, lambda e, x: e["a"] * x + e["b"], F.lit(1), "bigint", fan)
    expected = {}
    for key in "abc":
        x = 1
        for _, block, a, b in sorted(r for r in rows if r[0] == key):
            expected[key, block] = x
            x = a * x + b
    assert {(r.key, r._block): r._entry for r in entries.collect()} == expected


def test_no_blocks(spark):
    none = spark.createDataFrame([], "key string, _block bigint, _element bigint")
    assert block_entries(none, ["key"], lambda a, b: a + b, lambda e, x: e + x, F.lit(0), "bigint").collect() == []
    with pytest.raises(ValueError):
        block_entries(none, ["key"], lambda a, b: a + b, lambda e, x: e + x, F.lit(0), "bigint", 1)
