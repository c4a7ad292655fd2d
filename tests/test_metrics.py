"""Known answers of the quality metrics, gates, losses and telemetry."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lanespan.functions.exprs import stable_sigmoid
from lanespan.functions.ordered import block_of, running_total, with_position
from lanespan.functions import quantiles
from lanespan.functions.quantiles import exact_percentiles
from lanespan.operators import predict, scoring, telemetry
from lanespan.plans import ORACLES, QUERIES
from tests.conftest import DIMS, RUNS


def matrix_table(spark, masks):
    rows = [("g", i, y, x, x + 1) for i, m in enumerate(masks) for y, x in zip(*map(lambda a: a.tolist(), np.nonzero(m)))]
    return spark.createDataFrame(rows, RUNS)


def sizes(spark, masks):
    return spark.createDataFrame([("g", i, *m.shape) for i, m in enumerate(masks)], DIMS)


def test_known_scores(spark):
    pred = [np.array([[1, 1], [0, 0]]), np.array([[1, 0], [0, 0]])]
    truth = [np.array([[1, 0], [1, 0]]), np.zeros((2, 2), int)]
    args = matrix_table(spark, pred), matrix_table(spark, truth), sizes(spark, pred)
    row = scoring.evaluation_report(*args).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 2, 1, 4)
    assert row.iou == 1 / 4 and row.dice_f1 == 2 / 5 and row.precision == pytest.approx(1 / 3) and row.recall == 1 / 2
    assert row.no_road_pixel_fpr == 0.25 and row.no_road_frame_fpr == 1.0
    assert (row.frames, row.negative_frames, row.boundary_ratio) == (2, 1, 0.02)


def test_empty_agreement_is_one_and_full_masks_have_a_boundary(spark):
    empty = spark.createDataFrame([], RUNS)
    dims = spark.createDataFrame([("g", 0, 20, 30)], DIMS)
    row = scoring.evaluation_report(empty, empty, dims).first()
    assert row.iou == row.dice_f1 == row.precision == row.recall == row.boundary_iou == 1.0
    assert row.no_road_pixel_fpr == 0.0
    full = spark.createDataFrame([("g", 0, y, 0, 30) for y in range(20)], RUNS)
    facts = scoring.frame_facts(full, full, dims, 1).first()
    assert facts.boundary_union == facts.boundary_intersection == 2 * 30 + 2 * 18
    positive = scoring.negative_rates(scoring.frame_facts(full, full, dims)).first()
    assert positive.no_road_pixel_fpr is None and positive.no_road_frame_fpr is None


def test_shifted_rectangle_boundary(spark):
    truth, pred = np.zeros((48, 80), bool), np.zeros((48, 80), bool)
    truth[10:40, 20:60] = True
    pred[10:40, 22:62] = True
    row = scoring.evaluation_report(
        matrix_table(spark, [pred]), matrix_table(spark, [truth]), sizes(spark, [pred]), 0.01
    ).first()
    ring = []
    for m in (pred, truth):
        p = np.pad(m, 1)
        inner = np.ones_like(m)
        for dy in range(3):
            for dx in range(3):
                inner &= p[dy : dy + 48, dx : dx + 80]
        ring.append(m & ~inner)
    assert row.boundary_iou == (ring[0] & ring[1]).sum() / (ring[0] | ring[1]).sum()
    assert row.iou == (pred & truth).sum() / (pred | truth).sum()


def test_hot_frame_of_repeated_spans(spark):
    """A third of all spans are copies of one span of one frame."""
    copies = spark.range(20000).select(
        F.lit("g").alias("group"), F.lit(0).cast("long").alias("frame_idx"), *[F.lit(v).alias(n) for n, v in (("y", 1), ("x0", 2), ("x1", 7))]
    )
    dims = spark.createDataFrame([("g", 0, 4, 10)], DIMS)
    facts = scoring.frame_facts(copies, copies.limit(10), dims).first()
    assert (facts.tp, facts.fp, facts.fn, facts.tn) == (5, 0, 0, 35)


@pytest.mark.parametrize(
    "candidate, quantized, enforce, failed",
    [(0.7, True, False, True), (0.7, False, False, False), (0.7, False, True, True), (0.78, True, False, False)],
)
def test_gate(spark, candidate, quantized, enforce, failed):
    df = spark.createDataFrame(
        [(0.8, candidate, 0.6, 0.5, 4.0, 2.0, quantized)],
        "baseline_iou double, candidate_iou double, baseline_boundary_iou double, candidate_boundary_iou double, "
        "baseline_mean_ms double, candidate_mean_ms double, quantized boolean",
    )
    row = scoring.comparison_gate(df, 0.02, enforce).first()
    assert row.acceptance_gate_failed == failed and row.inference_speedup == 2.0
    assert row.boundary_iou_delta_points == pytest.approx(-10)
    with pytest.raises(ValueError):
        scoring.comparison_gate(df, 2.0)


def test_loss_is_weighted_by_sample(spark):
    rows = [([x] * 16, [t] * 16) for x, t in ((-0.7, 0.0), (0.4, 1.0), (2.0, 0.0))]
    df = spark.createDataFrame(rows, "logit array<double>, target array<double>")
    expected = []
    for (x, *_), (t, *_) in rows:
        p = 1 / (1 + math.exp(-x))
        bce = -(t * math.log(p) + (1 - t) * math.log(1 - p))
        expected.append(bce + 1 - (2 * 16 * p * t + 1) / (16 * p + 16 * t + 1))
    for parts in (1, 3):
        assert scoring.segmentation_loss(df.repartition(parts)).first().loss == pytest.approx(np.mean(expected))


def test_sigmoid_does_not_overflow(spark):
    values = [-1000.0, -2.0, 0.0, 3.0, 1000.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = [r[0] for r in df.select(stable_sigmoid("x")).collect()]
    np.testing.assert_allclose(found, [0, 1 / (1 + math.exp(2)), 0.5, 1 / (1 + math.exp(-3)), 1], atol=1e-12)


def test_bad_maps_are_named(spark):
    nan, inf = float("nan"), float("inf")
    maps = [[0.0, 1.0], [0.5], [nan, 0.2], [inf, 0.1], [None, 0.1], [1.1, 0.0], [-0.1, 0.0], None]
    df = spark.createDataFrame([("g", i, 1, 2, m) for i, m in enumerate(maps)], DIMS + ", p array<double>")
    faults = {r.frame_idx: r.fault for r in scoring.bad_probabilities(df).collect()}
    assert faults == {1: "shape", 2: "non-finite", 3: "non-finite", 4: "non-finite", 5: "range", 6: "range", 7: "shape"}
    assert [r.frame_idx for r in scoring.good_probabilities(df).collect()] == [0]


def test_backend_parity(spark):
    df = spark.createDataFrame([([0.5, 0.25], [0.5, 0.2]), ([1.0, 0.0], [1.0, 0.0])], "expected array<double>, actual array<double>")
    row = scoring.backend_parity(df).first()
    assert row.max_abs_error == pytest.approx(0.05) and row.mean_abs_error == pytest.approx(0.0125)
    assert not row.within_tolerance and scoring.backend_parity(df, atol=0.06).first().within_tolerance
    meta = dict(input_width=1, input_height=1, roi_top=0.2, preprocess_version=1, architecture="a")
    assert scoring.backend_metadata_agrees(meta, dict(meta, extra=1))
    assert not scoring.backend_metadata_agrees(meta, dict(meta, roi_top=0.1))
    maps = spark.createDataFrame([("g", 0, [0.5])], "group string, frame_idx long, p array<double>")
    assert scoring.backend_pairs(maps, maps, meta, meta).count() == 1
    with pytest.raises(ValueError, match="cannot be compared"):
        scoring.backend_pairs(maps, maps, meta, dict(meta, input_width=2))
    with pytest.raises(ValueError):
        predict.pick_backend({}, "onnxruntime")
    with pytest.raises(ValueError):
        predict.pick_backend({"x": negative}, "x")


def negative():
    return lambda images: -images


def test_predictions_are_thresholded_inclusively_and_restored(spark):
    maps = spark.createDataFrame([("g", 0, 2, 2, [0.55, 0.54, 0.0, 1.0])], DIMS + ", p array<double>")
    plan = dict(original_height=5, original_width=4, roi_y=1, input_width=2, input_height=2, left=0, top=0, content_width=2, content_height=2)
    plans = maps.select("group", "frame_idx", F.struct(*[F.lit(v).alias(k) for k, v in plan.items()]).alias("plan"))
    rows = scoring.predicted_runs(maps, plans).orderBy("y").collect()
    assert [(r.y, r.x0, r.x1) for r in rows] == [(1, 0, 2), (2, 0, 2), (3, 2, 4), (4, 2, 4)]
    with pytest.raises(Exception, match="bad probability map"):
        scoring.predicted_runs(maps.withColumn("p", F.array(F.lit(2.0))), plans).collect()
    with pytest.raises(ValueError):
        scoring.predicted_runs(maps, plans, 1.0)


def test_predictor_contract(spark):
    def negate():
        return lambda images: -images.reshape(len(images), -1)

    rng = np.random.default_rng(7)
    values = [rng.random(2 * 3 * 1).astype(float).tolist() for _ in range(20)]
    df = spark.createDataFrame([(v,) for v in values], "tensor array<double>")
    scored = predict.score_frames(df, negate, 2, 3, batch_size=4, channels=1).collect()
    for row in scored:
        np.testing.assert_allclose(row.p, 1 / (1 + np.exp(np.array(row.tensor))), atol=1e-6)
    for bad in ([1.0] * 5, [float("nan")] * 6):
        with pytest.raises(Exception, match="bad predictor input"):
            predict.score_frames(spark.createDataFrame([(bad,)], "tensor array<double>"), negate, 2, 3, channels=1).collect()


def test_a_predictor_may_compute_in_doubles(spark):
    value = 0.1 + 2.0**-40
    df = spark.createDataFrame([([value] * 6,)], "tensor array<double>")
    same = lambda: lambda images: images.reshape(len(images), -1)
    kept = lambda p: predict.score_frames(df, same, 2, 3, output_kind="probabilities", channels=1, precision=p).first().p
    assert kept("double") == [value] * 6
    assert kept("float") == [float(np.float32(value))] * 6
    with pytest.raises(ValueError):
        kept("half")


def test_scored_frames_equal_the_sql(spark):
    scored = QUERIES["score_frames"](spark, "/root/testdata/sf0.1").collect()
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    expected = con.execute(ORACLES["score_frames"]).fetchall()
    assert {(r["group"], r.frame_idx): r.p for r in scored} == {(g, i): p for g, i, p in expected}


def test_vectors_without_components_are_no_frames(spark, tmp_path):
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT vec_id, CASE vec_id WHEN 3 THEN NULL WHEN 4 THEN [] ELSE embedding END AS embedding, label
        FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE vec_id < 20) TO '{tmp_path}/embeddings.parquet'"""
    )
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    scored = QUERIES["score_frames"](spark, str(tmp_path)).collect()
    expected = con.execute(ORACLES["score_frames"]).fetchall()
    assert len(scored) == 18 and {(r["group"], r.frame_idx): r.p for r in scored} == {(g, i): p for g, i, p in expected}


# ---------------------------------------------------------------- telemetry


def test_known_telemetry(spark):
    done = [9.0, 9.5, 10.0, 10.1, 10.2, 10.4]
    completions = spark.createDataFrame([(1, i, t - 0.05, t) for i, t in enumerate(done)], "run_id int, frame_seq long, captured_at double, completed_at double")
    spent = [9.0, 9.0, 0.01, 0.02, 0.03, 0.04]
    timings = spark.createDataFrame([(1, i, "inference", s) for i, s in enumerate(spent)], "run_id int, frame_seq long, stage string, seconds double")
    measured = telemetry.drop_warmup(completions, 2)
    stages = {r.stage: r for r in telemetry.stage_summary(completions, timings, 2).collect()}
    assert stages["inference"].mean_ms == pytest.approx(25) and stages["inference"].p95_ms == pytest.approx(38.5)
    assert stages["inference"].median_ms == pytest.approx(25) and stages["inference"].frames == 4
    assert stages["total"].mean_ms == pytest.approx(50) and stages["render"].mean_ms == 0 and len(stages) == 8
    assert telemetry.average_fps(measured).first().average_fps == pytest.approx(7.5)
    assert telemetry.min_sustained_fps(measured, 3).first().min_sustained_fps == pytest.approx(2 / 0.3)
    assert telemetry.min_sustained_fps(measured, 30).first().min_sustained_fps is None
    assert telemetry.drop_warmup(completions, 6).isEmpty()
    with pytest.raises(Exception, match="no measured frames"):
        telemetry.latency_summary(timings.filter("seconds < 0"), "seconds").collect()


@pytest.mark.parametrize("small, broadcast", [(40, 100_000), (400, 0)])
def test_percentiles_cut_again_and_again(spark, monkeypatch, small, broadcast):
    """Ranges are cut until few rows are left, whatever the values; hot keys and hot values included."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(1)
    values = {
        "hot": np.r_[rng.lognormal(0, 4, 6000), np.full(5000, 7.25)],
        "wide": np.r_[10.0 ** rng.uniform(-4, 4, 800), -(10.0 ** rng.uniform(-4, 4, 700)), [1.7e308, -1.7e308]],
        "near": 1e15 + rng.integers(0, 3, 900) * 0.125,
        "one": np.array([-3.5]),
        "endless": np.array([-np.inf, 1.0, 2.0, 3.0, np.inf] * 9),
    }
    rows = [(k, float(x)) for k, own in values.items() for x in own] + [("hot", None), ("none", None)]
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.95, "top": 1.0}
    found = {r.k: r for r in exact_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", wanted).collect()}
    assert set(found) == set(values)
    for k, own in values.items():
        assert found[k].n == len(own)
        ordered = np.sort(own)
        for name, q in wanted.items():
            at = q * (len(own) - 1)
            lo, hi = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            if np.isfinite(lo) and np.isfinite(hi):
                assert found[k][name] == pytest.approx(lo + (hi - lo) * (at - np.floor(at)), rel=1e-12)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact_percentiles_with_a_hot_key(spark, keys):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.lognormal(2, 2, 5000), np.full(3000, 3.5), rng.integers(0, 5, 2000)])
    k = np.where(rng.random(len(values)) < 0.4, 0, rng.integers(1, 9, len(values)))
    df = spark.createDataFrame(list(zip(k.tolist(), values.tolist())), "k int, v double")
    wanted = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0, "e": 0.333}
    for row in exact_percentiles(df, keys, "v", wanted).collect():
        part = values[k == row.k] if keys else values
        assert row.n == len(part) and row.mean == pytest.approx(part.mean())
        for name, q in wanted.items():
            assert row[name] == pytest.approx(np.percentile(part, q * 100), rel=1e-12)


def test_positions_and_totals_across_blocks(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), (F.col("id") * 3).alias("t")
    )
    placed = with_position(df.repartition(5), ["k"], ["t"], block_of("t", 100))
    sums = running_total(placed.withColumn("one", F.lit(1)), ["k"], "pos", {"s": "one"}, size=64)
    rows = sums.collect()
    expected = {}
    for r in sorted(rows, key=lambda r: r.t):
        assert r.pos == expected.get(r.k, 0)
        expected[r.k] = r.pos + 1
        assert r.s == r.pos + 1
    assert len(rows) == 5000


def test_camera_keeps_newest_and_counts_drops(spark):
    df = spark.createDataFrame([("a", i) for i in range(80)] + [("b", 5)], "group string, frame_idx long")
    assert sorted((r.group, r.frame_idx) for r in telemetry.latest_frames(df, 3).collect()) == [("a", 77), ("a", 78), ("a", 79), ("b", 5)]
    for r in telemetry.dropped_frames(df, 3).collect():
        assert r.frames_read == r.frames_processed + r.frames_dropped
    with pytest.raises(ValueError):
        telemetry.latest_frames(df, 4)


@pytest.mark.parametrize(
    "row, fault",
    [
        (("file", 24, 24, 24, 24, False, True, 24, 17.5, 17.5), None),
        (("file", 24, 23, 24, 24, False, True, 24, 17.5, 17.5), "processed differs from read"),
        (("file", 24, 24, 24, 25, False, True, 24, 17.5, 17.5), "read differs from source"),
        (("file", 24, 24, 24, 0, False, False, 0, 17.5, 17.5), None),
        (("file", 24, 24, 23, 24, False, True, 23, 17.5, 17.5), "written differs from read"),
        (("file", 24, 20, 10, 24, True, True, 9, 17.5, 1.0), None),
        (("camera", 80, 30, 30, 0, False, True, 30, 17.5, 17.6), "output not preserved"),
        (("camera", 80, 30, 30, 0, False, True, 30, 17.5, 17.505), None),
    ],
)
def test_accounting_rules(spark, row, fault):
    names = "source_mode string, frames_read int, frames_processed int, frames_written int, expected int, interrupted boolean, has_output boolean, output_frames int, source_fps double, output_fps double"
    assert spark.createDataFrame([row], names).select(telemetry.accounting_fault()).first()[0] == fault


def test_sizes_and_frames_have_to_agree(spark):
    kind = "group string, frame_idx bigint, expected array<double>, actual array<double>"
    fine = ("g", 0, [0.1, 0.2], [0.1, 0.2])
    for bad in ([0.1, 0.2], [0.1]), ([], []), ([0.1], None):
        with pytest.raises(Exception, match="differ in shape"):
            scoring.backend_parity(spark.createDataFrame([fine, ("g", 1, *bad)], kind)).collect()
    with pytest.raises(Exception, match="no outputs"):
        scoring.backend_parity(spark.createDataFrame([], kind)).collect()
    loss = spark.createDataFrame([([0.1, 0.2], [1.0, 0.0]), ([0.1, 0.2], [1.0])], "logit array<double>, target array<double>")
    with pytest.raises(Exception, match="differ in shape"):
        scoring.segmentation_loss(loss).collect()
    dims = spark.createDataFrame([("g", 0, 4, 4)], DIMS)
    inside = spark.createDataFrame([("g", 0, 1, 0, 2)], RUNS)
    for wrong, message in ((("g", 0, 7, 0, 9), "outside"), (("g", 0, 1, 0, 5), "outside"), (("g", 3, 1, 0, 2), "without dims")):
        table = spark.createDataFrame([wrong], RUNS)
        for args in ((table, inside), (inside, table)):
            with pytest.raises(Exception, match=message):
                scoring.frame_facts(*args, dims).collect()
    one = scoring.frame_facts(inside, inside, dims)
    two = scoring.frame_facts(inside, inside, dims.union(spark.createDataFrame([("g", 1, 4, 4)], DIMS)))
    with pytest.raises(Exception, match="only one side"):
        scoring.compare_runs(one, two).collect()


def test_a_run_that_ends_in_the_warm_up_is_not_lost(spark):
    rows = [(r, i, float(i), i + 0.5) for r, n in ((1, 6), (2, 2)) for i in range(n)]
    completions = spark.createDataFrame(rows, "run_id int, frame_seq long, captured_at double, completed_at double")
    timings = spark.createDataFrame([(1, i, "inference", 0.01) for i in range(6)], "run_id int, frame_seq long, stage string, seconds double")
    found = {(r.run_id, r.stage): r for r in telemetry.stage_summary(completions, timings, 2).collect()}
    assert len(found) == 16
    assert all((found[2, s].frames, found[2, s].mean_ms, found[2, s].p95_ms) == (0, None, None) for s in ("inference", "total"))
    measured = telemetry.drop_warmup(completions, 2)
    rates = {r.run_id: r for r in telemetry.average_fps(measured, completions).collect()}
    assert (rates[2].frames, rates[2].average_fps) == (0, None) and rates[1].average_fps == pytest.approx(1.0)
    slow = {r.run_id: r.min_sustained_fps for r in telemetry.min_sustained_fps(measured, 3, completions).collect()}
    assert slow == {1: pytest.approx(1.0), 2: None}
