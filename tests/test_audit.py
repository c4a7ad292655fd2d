"""Audit, splits, provenance and training history on small tables."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lanespan.functions import exprs
from lanespan.operators import audit, provenance, splitting, training

SAMPLE = "split string, group string, image string, mask string, image_hash string, mask_hash string, negative boolean"


def manifest(change=None):
    rows = []
    for split, group in (("train", "trip0"), ("validation", "trip1"), ("test", "trip2")):
        for i in range(2):
            rows.append([split, group, f"{group}/i{i}", f"{group}/m{i}", f"h{group}{i}", f"k{i}", i == 0])
    if change:
        change(rows)
    return rows


@pytest.fixture
def table(spark):
    return lambda change=None: spark.createDataFrame(manifest(change), SAMPLE)


def test_clean_manifest_passes(table):
    audit.require_clean(table())


def put(index, column, value):
    def change(rows):
        rows[index][column] = value

    return change


def no_negatives(rows):
    for r in rows:
        r[6] = r[6] and r[0] != "test"


@pytest.mark.parametrize(
    "change, message",
    [
        (put(2, 1, "trip0"), "group leakage"),
        (put(4, 4, "htrip00"), "content leakage"),
        (put(1, 2, "trip0/i0"), "overlapping"),
        (put(1, 3, "trip2/i1"), "overlapping"),
        (no_negatives, "no negative"),
        (lambda rows: rows.__delitem__(slice(4, 6)), "empty split"),
        (put(1, 1, "  "), "blank group"),
        (put(1, 1, None), "blank group"),
        (put(1, 0, None), "unknown split"),
    ],
)
def test_manifest_faults(table, change, message):
    with pytest.raises(ValueError, match=message):
        audit.require_clean(table(change))


def test_negatives_can_be_optional_and_copies_inside_a_split_are_allowed(table):
    audit.require_clean(table(no_negatives), require_negatives=False)
    audit.require_clean(table(put(1, 4, "htrip00")))


def test_digest_does_not_depend_on_order(spark):
    rows = [
        ("train", 'é"\\\n', "h1", "k"),
        ("train", "поездка 😀", "h2", "k"),
        ("test", "a\x7f\tb", "h3", "k"),
        ("test", "plain-1.x", "h3", "k"),
        ("test", "plain-1.x", "h3", "k"),
    ]
    df = spark.createDataFrame(rows, "split string, group string, image_hash string, mask_hash string")
    digest = audit.dataset_digest(df).first()
    assert digest == audit.dataset_digest(df.orderBy(F.rand()).repartition(3)).first()
    assert digest != audit.dataset_digest(df.limit(4)).first() and digest.records == 5


def test_content_digest_covers_shape_and_bytes(spark):
    pixels = bytes(range(24))
    df = spark.createDataFrame([(bytearray(pixels),)], "pixels binary")
    found = df.select(
        exprs.content_digest("pixels", F.lit(2), F.lit(4), F.lit(3)), exprs.content_digest("pixels", F.lit(4), F.lit(6))
    ).first()
    assert found[0] == hashlib.sha256(b"(2, 4, 3)" + pixels).hexdigest()
    assert found[1] == hashlib.sha256(b"(4, 6)" + pixels).hexdigest()


def test_pairing_faults(spark):
    files = [
        ("t", "image", "a/1.PNG"),
        ("t", "mask", "m/1_mask.bmp"),
        ("t", "image", "a/2.png"),
        ("t", "mask", "m/3.png"),
        ("t", "image", "a/4.png"),
        ("t", "image", "a/4.jpg"),
        ("t", "mask", "m/4.png"),
        ("t", "image", "a/5.x.png"),
        ("t", "mask", "m/5.x.png"),
        ("t", "mask", "m/5.x_mask.png"),
        ("u", "image", "b/1.png"),
        ("u", "mask", "n/1_mask_mask.png"),
    ]
    df = spark.createDataFrame(files, "group string, kind string, path string")
    pairs = {(r.group, r.stem): r.fault for r in audit.pair_images_masks(df).collect()}
    assert pairs == {
        ("t", "1"): None,
        ("t", "2"): "missing mask",
        ("t", "3"): "orphan mask",
        ("t", "4"): "duplicate image",
        ("t", "5.x"): "ambiguous mask",
        ("u", "1"): "missing mask",
        ("u", "1_mask"): "orphan mask",
    }
    assert audit.samples_of(audit.pair_images_masks(df)).collect() == [("t", "a/1.PNG", "m/1_mask.bmp")]


@pytest.mark.parametrize(
    "facts, fault",
    [
        ((True, True, 1, 48, 80, 48, 80, [0, 255]), None),
        ((True, True, 1, 48, 80, 48, 80, [1, 1]), None),
        ((False, True, 1, 48, 80, 48, 80, [0]), "missing file"),
        ((True, False, 3, 48, 80, 20, 20, [0]), "unreadable"),
        ((True, True, 3, 48, 80, 20, 20, [0]), "not single-channel"),
        ((True, True, 1, 48, 80, 20, 20, [127]), "size mismatch"),
        ((True, True, 1, 48, 80, 48, 80, [127]), "non-binary"),
        ((True, True, 1, 48, 80, 48, 80, [0, 1, 255]), "non-binary"),
    ],
)
def test_pair_faults_in_order(spark, facts, fault):
    schema = "mask_exists boolean, readable boolean, channels int, height int, width int, mask_height int, mask_width int, mask_values array<int>"
    assert spark.createDataFrame([facts], schema).select(audit.pair_fault()).first()[0] == fault


def test_group_names(spark):
    names = ["trip_1", "a.b-c", "поездка", ".", "..", "", "a b", "a/b", "a\n", None]
    df = spark.createDataFrame([(n,) for n in names], "g string")
    ok = [r[0] for r in df.select(exprs.valid_extraction_group("g")).collect()]
    assert ok == [True, True, True, False, False, False, False, False, False, False]
    blank = spark.createDataFrame([("x ",), ("  ",), ("",), (None,)], "g string")
    assert [r[0] for r in blank.select(exprs.valid_manifest_group("g")).collect()] == [True, False, False, False]


# ---------------------------------------------------------------- splits


def test_cuts_of_known_sizes(spark):
    def naive(n):
        sizes = [max(1, math.floor(n * share)) for share in splitting.RATIOS]
        if sum(sizes) > n:
            sizes[0] -= 1
        missing = sorted(range(3), key=lambda k: (sizes[k] - n * splitting.RATIOS[k], k))
        for k in missing[: n - sum(sizes)]:
            sizes[k] += 1
        return sizes

    numbers = spark.range(3, 400).withColumnRenamed("id", "n")
    second, third = splitting.cuts(F.col("n"))
    for r in numbers.select("n", second.alias("a"), third.alias("b")).collect():
        assert [r.a, r.b - r.a, r.n - r.b] == naive(r.n)
    assert naive(20) == [14, 3, 3] and naive(3) == [1, 1, 1]
    few = spark.createDataFrame([("a",), ("b",)], "group string")
    with pytest.raises(Exception, match="three"):
        splitting.assign_groups(few).collect()


def test_split_is_by_group_and_reproducible(spark):
    rows = [(str(i // 4), str(i), str(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "group string, image string, mask string")
    first = {r.group: r.split for r in splitting.assign_groups(df, 42).collect()}
    assert first == {r.group: r.split for r in splitting.assign_groups(df.repartition(7), 42).collect()}
    assert first != {r.group: r.split for r in splitting.assign_groups(df, 43).collect()}
    sizes = [list(first.values()).count(s) for s in exprs.SPLITS]
    assert sizes == [14, 3, 3]
    assert splitting.apply_split(df, splitting.assign_groups(df)).count() == 80


def test_round_robin_sample_equals_sequential_rule(spark):
    rng = random.Random(1)
    rows = [("train", f"g{min(i % 9, 3)}", f"img{i}", f"h{rng.randrange(330)}") for i in range(900)]
    rows += [("test", "gt", f"t{i}", f"x{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "split string, group string, image string, image_hash string")
    key = lambda s: hashlib.sha256(f"7|{s}".encode()).hexdigest()
    queues = {}
    for split, group, image, digest in rows:
        if split == "train":
            queues.setdefault(group, []).append((key(image), image, digest))
    names = sorted(queues, key=lambda g: (key(g), g))
    for q in queues.values():
        q.sort(reverse=True)
    chosen, seen = [], set()
    while len(chosen) < 210 and any(queues.values()):
        for name in names:
            if queues[name]:
                _, image, digest = queues[name].pop()
                if digest not in seen and len(chosen) < 210:
                    seen.add(digest)
                    chosen.append(image)
    found = splitting.round_robin_sample(df, 210, 7)
    assert sorted(r.image for r in found.collect()) == sorted(chosen)
    row = splitting.calibration_provenance(found, 210, 7, "f").first()
    assert row["count"] == 210 and len(row.image_hashes) == 210 and row.split == "train"
    for bad in (100, 501):
        with pytest.raises(ValueError):
            splitting.round_robin_sample(df, bad)
    with pytest.raises(Exception, match="unique training images"):
        splitting.round_robin_sample(df, 400, 7).collect()
    short = splitting.round_robin_sample(df, 400, 7, allow_short=True)
    with pytest.raises(Exception, match="need 400 unique"):
        splitting.calibration_provenance(short, 400, 7, "f").collect()


# ---------------------------------------------------------------- provenance


def members(spark, rows):
    return spark.createDataFrame(rows, "artifact_id string, field string, value string")


def test_provenance_verdicts(spark, table):
    current = audit.split_members(table())
    fields = list(provenance.REQUIRED_FIELDS)
    artifacts = spark.createDataFrame(
        [("leak", fields, None), ("clean", fields, None), ("old", [], None), ("cal", fields, True), ("part", fields, False)],
        "artifact_id string, fields array<string>, provenance_complete boolean",
    )
    rows = members(
        spark,
        [
            ("leak", "training_groups", "trip2"),
            ("clean", "training_groups", "trip9"),
            ("old", "validation_image_hashes", "htrip21"),
            ("cal", "calibration_image_hashes", "htrip20"),
        ],
    )
    verdicts = lambda split, allow: {
        r.artifact_id: r.verdict
        for r in provenance.provenance_status(artifacts, rows, current, split, allow).collect()
    }
    incomplete = "incomplete provenance"
    assert verdicts("test", False) == {"leak": "leakage", "clean": None, "old": "leakage", "cal": "leakage", "part": incomplete}
    assert verdicts("test", True) == {"leak": "leakage", "clean": None, "old": "leakage", "cal": "leakage", "part": None}
    assert verdicts("validation", False) == {"leak": None, "clean": None, "old": incomplete, "cal": None, "part": incomplete}
    with pytest.raises(ValueError):
        verdicts("train", False)


def test_merging_provenance(spark, table):
    prior = members(spark, [("a", "training_groups", "old"), ("a", "calibration_groups", "c"), ("b", "training_groups", "x")])
    merged = provenance.merge_members(prior, audit.split_members(table()), "a").collect()
    groups = {(r.field, r.value) for r in merged if r.field.endswith("groups")}
    assert groups == {("training_groups", "old"), ("training_groups", "trip0"), ("validation_groups", "trip1")}
    complete = spark.createDataFrame([("a", list(provenance.REQUIRED_FIELDS), None)], "artifact_id string, fields array<string>, provenance_complete boolean")
    assert provenance.merged_complete(None) and provenance.merged_complete(complete)
    assert not provenance.merged_complete(complete.withColumn("fields", F.array(F.lit("training_groups"))))


def test_merging_provenance_of_every_artifact(spark):
    prior = members(spark, [("a", "training_groups", "old"), ("b", "calibration_groups", "c")])
    current = spark.createDataFrame(
        [("a", "train", "group", "t"), ("a", "test", "group", "x"), ("b", "validation", "image_hash", "h"), ("new", "train", "group", "y")],
        "artifact_id string, split string, kind string, value string",
    )
    found = {tuple(r) for r in provenance.merge_members(prior, current).select("artifact_id", "field", "value").collect()}
    assert found == {("a", "training_groups", "old"), ("a", "training_groups", "t"), ("b", "validation_image_hashes", "h")}


CHAIN = "artifact_id string, prior_id string, fields array<string>, provenance_complete boolean"


def test_chains_of_artifacts(spark):
    """Five in a row, a branch, a prior nobody knows, an incomplete one in the middle."""
    full = list(provenance.REQUIRED_FIELDS)
    rows = [("a", None, full, None), ("b", "a", full, None), ("c", "b", full[:3], None), ("d", "c", full, True), ("e", "d", full, None), ("f", "b", full, False), ("g", "lost", full, None)]
    own = members(spark, [(k, "training_groups", f"group {k}") for k, *_ in rows] + [("a", "calibration_groups", "none")])
    merged, status = provenance.merge_chains(spark.createDataFrame(rows, CHAIN), own)
    found = {}
    for r in merged.collect():
        found.setdefault(r.artifact_id, set()).add(r.value[-1])
    assert {k: "".join(sorted(v)) for k, v in found.items()} == {"a": "a", "b": "ab", "c": "abc", "d": "abcd", "e": "abcde", "f": "abf", "g": "g"}
    assert {r.artifact_id: (r.depth, r.complete) for r in status.collect()} == {
        "a": (0, True), "b": (1, True), "c": (2, True), "d": (3, False), "e": (4, False), "f": (2, True), "g": (1, False),
    }
    with pytest.raises(ValueError):
        provenance.ancestors(spark.createDataFrame([("x", "y", full, None), ("y", "z", full, None), ("z", "y", full, None)], CHAIN))
    assert provenance.ancestors(spark.createDataFrame([], CHAIN)).collect() == []


RAW = (
    "artifact_id int, input_width int, input_height int, image_size int, preprocess_version int, roi_top double, "
    "architecture string, output_kind string, class_names array<string>"
)


@pytest.mark.parametrize(
    "values, expected",
    [
        ((256, 144, None, None, None, None, None), (256, 144, 0.2, 1, None)),
        ((None, None, 192, None, None, None, None), (192, 192, 0.0, 0, None)),
        ((None, None, None, None, None, None, None), "no input size"),
        ((256, None, None, None, None, None, None), "both input sizes required"),
        ((250, 144, None, None, None, None, None), "not a multiple of 16"),
        ((8, 8, None, 0, None, None, None), "input too small"),
        ((256, 144, None, 2, None, None, None), "unsupported version"),
        ((256, 144, None, None, 1.0, None, None), "roi_top out of range"),
        ((192, 192, None, 0, 0.2, None, None), "legacy input must be square and uncropped"),
        ((256, 144, None, None, None, "big_net", None), "unknown architecture"),
        ((256, 144, None, None, None, None, "labels"), "unknown output kind"),
    ],
)
def test_artifact_rules(spark, values, expected):
    row = provenance.normalize_artifacts(spark.createDataFrame([(1, *values, None)], RAW)).first()
    if isinstance(expected, str):
        assert row.error == expected
    else:
        assert (row.input_width, row.input_height, row.roi_top, row.preprocess_version, row.error) == expected
        assert row.class_names == ["background", "road"] and row.output_kind == "logits"


def test_history(spark):
    rows = [("r", 1, 0.5), ("r", 2, 0.5), ("r", 3, 0.7), ("r", 4, 0.6), ("r", 5, 0.7)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, iou double")
    assert [r.improved for r in training.running_best(df).orderBy("epoch").collect()] == [True, False, True, False, False]
    resumed = training.running_best(df, resumed_best=0.65).orderBy("epoch").collect()
    assert [r.improved for r in resumed] == [False, False, True, False, False]
    best = training.best_epoch(df).first()
    assert (best.best_epoch, best.best_score) == (3, 0.7)
    assert training.append_history(df, df.filter("epoch = 5"), 2).count() == 3
