"""Vector codes against plain Lloyd rounds in whole numbers, and odd tables."""

import hashlib
import math
import random

import numpy as np

from lanespan.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, entries=256, parts=4, rounds=4):
    """Codes, errors and codebooks by loops over Python numbers; ``rows`` are (vec_id, vector)."""
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows]
    width = len(whole[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in whole]
    order = sorted(range(len(whole)), key=lambda k: whole[k])[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for own in cut:
                members.setdefault(nearest(own[p], books[p])[1], []).append(own[p])
            for e, held in members.items():
                books[p][e] = [sum(column) // len(held) for column in zip(*held, strict=True)]
    best = [[nearest(own[p], books[p]) for p in range(parts)] for own in cut]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b)) for (i, _), b in zip(rows, best, strict=True)}, digest


def check(spark, rows, labels=None):
    labels = labels or {}
    table = spark.createDataFrame([(i, v, labels.get(i)) for i, v in rows], SCHEMA).repartition(3)
    found = vc.encode(table).collect()
    expected, digest = plain(rows)
    assert {r.vec_id: (r.code, r.error) for r in found} == expected and len(found) == len(rows)
    assert {r.codebooks_sha256 for r in found} == {digest}
    sums = {}
    for i, (_, error) in expected.items():
        sums[labels.get(i)] = sums.get(labels.get(i), 0) + error
    assert all(r.label_error == sums[labels.get(r.vec_id)] for r in found)


def test_codes_equal_plain_rounds(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(420)]
    check(spark, rows, {i: i % 3 for i in range(420) if i % 7})


def test_ties_and_repeated_vectors(spark):
    rng = random.Random(5)
    check(spark, [(i, [rng.choice([-0.002, 0.0, 0.002]) for _ in range(4)]) for i in range(400)])


def test_fewer_rows_than_entries(spark):
    check(spark, [(5, [0.5, -0.5, 0.25, 1.0]), (3, [0.5, -0.5, 0.25, 1.0]), (9, [1e5, -1e5, 0.0, 3.0])])


def test_active_entries_equal_a_full_look():
    rng = np.random.default_rng(2)
    part, books = rng.integers(-6, 7, (500, 3)), rng.integers(-6, 7, (40, 3))
    held, kept = vc._nearest(part, books)
    after = books.copy()
    changed = rng.choice(40, 9, replace=False)
    after[changed] += rng.integers(-2, 3, (9, 3))
    codes, found = vc.assign(part, after, held, kept, (after != books).any(axis=1))
    full, distance = vc._nearest(part, after)
    assert (codes == full).all() and (found == distance).all()


def test_distances_are_exact_beyond_float64():
    part, entries = np.array([[vc.REACH, -vc.REACH + 1]]), np.array([[-vc.REACH, vc.REACH], [0, 1]])
    expected = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, e, strict=True)) for e in entries] for x in part]
    assert vc.distances(part, entries).tolist() == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2, 0.3, 0.4], 1, "x"),
        (1, [0.1, 0.2, 0.3, 0.4], 1, "x"),
        (2, None, 1, "x"),
        (3, [0.1, None, 0.3, 0.4], 1, "x"),
        (4, [0.1, nan, 0.3, 0.4], None, "x"),
        (5, [inf, 0.2, 0.3, 0.4], None, "x"),
        (6, [0.5, 0.5], None, "x"),
        (7, [], None, "x"),
        (None, [3e38, -3e38, 0.0, 0.0], None, "x"),
    ]
    found = vc.encode(spark.createDataFrame(rows, f"{SCHEMA}, code string")).collect()
    assert sorted(r.vec_id for r in found if r.vec_id) == [1, 1, 6, 7] and len(found) == 5
    assert found[0].label_error == 0 and all(r.error == 0 for r in found)
    assert vc.encode(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vc.encode(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    assert [r.code for r in vc.encode(spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA)).collect()] == ["00000000"] * 2


def test_codes_stand_for_vectors(spark):
    rows = spark.createDataFrame([(i, [i * 0.01, 0.0, 1.0, -i * 0.02], None) for i in range(50)], SCHEMA)
    coded, books = vc.compress(vc.whole_vectors(rows).selectExpr("vec_id", "vector", "'' AS label_key"))
    for r in coded.collect():
        back = vc.decode(np.array([r.codes]), books)[0]
        assert ((back - np.array(r.vector)) ** 2).sum() == sum(r.distances)
