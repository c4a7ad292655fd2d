"""Merkle trees against plain loops, and differences that look only where trees differ."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lanespan.operators import fingerprint as fp


def rows(spark, n, changed=()):
    df = spark.range(n).selectExpr("id % 900 AS a", "cast(id AS string) AS b")
    return df.withColumn("b", F.when(F.col("b").isin(*map(str, changed)), "new").otherwise(F.col("b"))) if changed else df


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_tree_equals_a_loop(spark):
    records = fp.record_digests(rows(spark, 300).union(rows(spark, 40)), ["a", "b"])
    held = {r.digest: r.n for r in records.collect()}
    assert all(r.digest == sha(r.record) for r in records.collect()) and sum(held.values()) == 340
    nodes = {}
    for d, n in held.items():
        nodes.setdefault(d[:2], []).append(f"{d}:{n}")
    expected = {(2, p): sha(",".join(sorted(own))) for p, own in nodes.items()}
    for level in (1, 0):
        above = {}
        for (k, p), d in expected.items():
            if k == level + 1:
                above.setdefault(p[:level], []).append(f"{p}:{d}")
        expected |= {(level, p): sha(",".join(sorted(own))) for p, own in above.items()}
    tree = fp.merkle_tree(records, 2)
    assert {(r.level, r.prefix): r.digest for r in tree.collect()} == expected
    shuffled = fp.record_digests(rows(spark, 40).union(rows(spark, 300)).repartition(7).orderBy(F.rand(1)), ["a", "b"])
    assert {(r.level, r.prefix): r.digest for r in fp.merkle_tree(shuffled, 2).collect()} == expected
    assert tree.filter("level = 0").first().records == 340


def test_only_unequal_parts_are_entered(spark):
    left, right = (fp.record_digests(rows(spark, 2000, changed), ["a", "b"]) for changed in ((), (17,)))
    trees = [fp.merkle_tree(t, 2) for t in (left, right)]
    nodes = fp.unequal_nodes(*trees, 2).collect()
    assert len(nodes) <= 5 and {r.level for r in nodes} == {0, 1, 2}
    found = {(r.record, r.left_n, r.right_n) for r in fp.difference(left, right).collect()}
    assert found == {('["17", "17"]', 1, 0), ('["17", "new"]', 0, 1)}


def test_equal_empty_and_repeated_tables(spark):
    one = fp.record_digests(rows(spark, 200), ["a", "b"])
    assert fp.difference(one, fp.record_digests(rows(spark, 200).repartition(5), ["a", "b"])).collect() == []
    none = one.limit(0)
    assert fp.merkle_tree(none, 1).collect() == [] and fp.difference(none, none).collect() == []
    assert fp.difference(none, one).count() == 200
    twice = fp.record_digests(rows(spark, 200).union(rows(spark, 200).limit(1)), ["a", "b"])
    (r,) = fp.difference(one, twice).collect()
    assert (r.left_n, r.right_n) == (1, 2)
    assert fp.depth_for(0) == 0 and fp.depth_for(64) == 0 and fp.depth_for(65) == 1 and fp.depth_for(10**12) == 9
    with pytest.raises(ValueError):
        fp.merkle_tree(one, 64)
