"""Temporal rules, tracks and their streams."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanespan.operators import temporal, tracks
from lanespan.operators.components import hysteresis
from lanespan.operators.runs import pixels_to_runs
from lanespan.plans import views
from lanespan.sources.frames import stream_frames
from lanespan.streaming.intake import camera_intake, lossless_intake, run_to_end
from lanespan.streaming.temporal import _smoothed, filter_stream
from lanespan.streaming.tracks import track_stream
from tests.conftest import DIMS

FRAMES = "group string, frame_idx bigint, height int, width int, p_height int, p_width int, thumb array<float>, p array<double>"


def test_hysteresis_keeps_the_seeded_block(spark):
    p = np.zeros((20, 30))
    p[2:8, 2:12] = 0.5
    p[4, 5] = 0.8
    p[12:18, 15:25] = 0.5
    df = spark.createDataFrame([("g", 0, 20, 30, p.ravel().tolist())], DIMS + ", p array<double>")
    kept = hysteresis(df).agg(F.sum(F.col("x1") - F.col("x0"))).first()[0]
    assert kept == 60
    nan = float("nan")
    for bad in ([], [nan] * 600, [0.1] * 599, [1.5] * 600):
        wrong = df.withColumn("p", F.array(*[F.lit(v) for v in bad]).cast("array<double>"))
        with pytest.raises(Exception, match="bad probability map"):
            pixels_to_runs(wrong, 0.5).collect()
        with pytest.raises(Exception, match="bad probability map"):
            hysteresis(wrong).collect()
    with pytest.raises(ValueError):
        hysteresis(df, 0.7, 0.6)


def sequence(n=300, pixels=4, seed=1):
    rng = np.random.default_rng(seed)
    thumbs = np.cumsum(rng.random((n, 6)) * 0.1, axis=0) % 1.0
    thumbs[rng.random(n) < 0.05] = rng.random(6)
    return thumbs.astype(np.float32), rng.random((n, pixels)), rng.random(n) < 0.02


def frame_rows(thumbs, maps, resized, group="g"):
    size, rows = 10, []
    for i, (t, p) in enumerate(zip(thumbs, maps)):
        size += int(resized[i])
        rows.append((group, i, size, 10, 1, len(p), t.tolist(), p.tolist()))
    return rows


def expected_resets(thumbs, resized):
    moved = np.abs(np.diff(thumbs.astype(float), axis=0)).mean(axis=1) > 0.25
    return np.concatenate([[True], moved]) | resized


@pytest.mark.parametrize("alpha", [0.7, 0.05, 1.0])
def test_smoothing_is_independent_of_blocks(spark, alpha):
    thumbs, maps, resized = sequence(900 if alpha == 0.05 else 300)
    reset = expected_resets(thumbs, resized)
    expected, last = [], None
    for p, r in zip(maps, reset):
        last = p if r else alpha * p + (1 - alpha) * last
        expected.append(last)
    df = spark.createDataFrame(frame_rows(thumbs, maps, resized), FRAMES).repartition(4)
    rows = temporal.smooth(df, alpha, block=16).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in rows] == list(range(len(maps)))
    assert [r.was_reset for r in rows] == reset.tolist()
    np.testing.assert_allclose([r.p for r in rows], expected, rtol=1e-12)


@pytest.mark.parametrize("alpha", [0.01, 0.7, 1.0])
def test_smoothing_keeps_all_history(spark, alpha):
    n = 1200
    maps = np.zeros((n, 2))
    maps[0], maps[5, 1] = 1.0, 0.5
    thumbs = np.zeros((n, 2), np.float32)
    rows = [(g, i + first, h, 10, 1, len(p), *rest) for g, first in (("g", 0), ("late", 100)) for _, i, h, _, _, _, *rest in frame_rows(thumbs, maps, np.zeros(n, bool)) for p in [rest[1]]]
    found = temporal.smooth(spark.createDataFrame(rows, FRAMES), alpha).orderBy("frame_idx").collect()
    expected, last = [], maps[0]
    for i, p in enumerate(maps):
        last = p if i == 0 else alpha * p + (1 - alpha) * last
        expected.append(last)
    for group in ("g", "late"):
        own = [r for r in found if r.group == group]
        assert [r.was_reset for r in own] == [True] + [False] * (n - 1)
        got = np.array([r.p for r in own])
        exact = np.array(expected)
        kept = exact > 1e-290
        np.testing.assert_allclose(got[kept], exact[kept], rtol=1e-9)
        assert (got[~kept] <= 1e-289).all()


def stepwise(maps, resets, alpha, rest):
    """The recurrence, one frame after the other."""
    last, out = None, []
    for p, r in zip(maps, resets, strict=True):
        last = p if r or last is None else alpha * p + rest * last
        out.append(last)
    return np.array(out)


def test_batch_and_stream_smooth_bit_by_bit(spark):
    """Every block starts from the very bits the block before ends with, and the weights are 0.7 and 0.3."""
    rng = np.random.default_rng(5)
    maps = np.repeat(rng.integers(0, 101, (60, 8)) / 100, 12, axis=0)
    still = np.zeros((len(maps), 2), np.float32)
    expected = stepwise(maps, np.arange(len(maps)) == 0, 0.7, 0.3)
    df = spark.createDataFrame(frame_rows(still, maps, np.zeros(len(maps), bool)), FRAMES).repartition(4)
    for block in (1, 16, 64):
        rows = temporal.smooth(df, block=block).orderBy("frame_idx").collect()
        assert np.array_equal([r.p for r in rows], expected)
    found = np.vstack([_smoothed(maps[:7], maps[:0], 0.7), maps[:0]])
    found = np.vstack([found, _smoothed(maps[7:], found[-1:], 0.7)])
    assert np.array_equal(found, expected)


@pytest.mark.parametrize("alpha", [0.01, 0.3])
def test_slow_smoothing_is_exact_too(spark, alpha):
    thumbs, maps, resized = sequence(200, seed=9)
    expected = stepwise(maps, expected_resets(thumbs, resized), alpha, {0.01: 0.99, 0.3: 0.7}[alpha])
    df = spark.createDataFrame(frame_rows(thumbs, maps, resized), FRAMES).repartition(4)
    rows = temporal.smooth(df, alpha, block=16).orderBy("frame_idx").collect()
    assert np.array_equal([r.p for r in rows], expected)


def test_gaps_and_bad_maps_are_refused(spark):
    thumbs, maps, resized = sequence(40)
    good = spark.createDataFrame(frame_rows(thumbs, maps, resized), FRAMES)
    gap = good.filter("frame_idx <> 7")
    bad = good.withColumn("p", F.when(F.col("frame_idx") == 9, F.array(F.lit(float("nan")))).otherwise(F.col("p")))
    for run in (temporal.smooth, temporal.vote):
        with pytest.raises(Exception, match="gap before 8"):
            run(gap).collect()
        with pytest.raises(Exception, match="bad probability map"):
            run(bad).collect()


def test_votes_and_scenes_are_independent_of_blocks(spark):
    thumbs, maps, resized = sequence(seed=4)
    reset = expected_resets(thumbs, resized)
    on, start, expected = maps >= 0.3, 0, []
    for i, r in enumerate(reset):
        start = i if r else start
        expected.append(on[i] & (on[max(start, i - 4) : i + 1].sum(axis=0) >= 4))
    df = spark.createDataFrame(frame_rows(thumbs, maps, resized), FRAMES)
    rows = temporal.vote(df, 0.3, block=16).orderBy("frame_idx").collect()
    np.testing.assert_array_equal(np.array([r.p for r in rows]) == 1, expected)
    scenes = temporal.scene_segments(df).orderBy("frame_idx").collect()
    assert [r.segment for r in scenes] == np.cumsum(reset).tolist()


def test_known_smoothing_and_voting(spark):
    still = [0.5] * 4
    two = [("g", i, 4, 4, 1, 1, still, [p]) for i, p in enumerate((0.9, 0.2))]
    rows = temporal.smooth(spark.createDataFrame(two, FRAMES)).orderBy("frame_idx").collect()
    assert rows[1].p[0] == pytest.approx(0.7 * 0.2 + 0.3 * 0.9)
    five = [("g", i, 4, 4, 1, 1, still, [p]) for i, p in enumerate((0.9, 0.9, 0.9, 0.9, 0.0))]
    votes = temporal.vote(spark.createDataFrame(five, FRAMES)).orderBy("frame_idx").collect()
    assert [r.p[0] for r in votes] == [0, 0, 0, 1, 0]


def test_frames_with_gaps_are_numbered_first(spark):
    rows = [("g", 10 * i, 4, 4, 1, 1, [0.5], [0.1 * i]) for i in range(6)]
    df = temporal.consecutive(spark.createDataFrame(rows, FRAMES))
    out = temporal.smooth(df, pos="pos", block=64).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in out] == [0, 10, 20, 30, 40, 50] and [r.was_reset for r in out] == [True] + [False] * 5


@pytest.mark.parametrize("mode", ["ema", "legacy", "none"])
def test_filter_modes_yield_spans(spark, mode):
    thumbs, maps, resized = sequence(40, 12)
    df = spark.createDataFrame(frame_rows(thumbs, maps, resized), FRAMES)
    spans = temporal.temporal_filter(df, mode).collect()
    assert spans and all(0 <= r.x0 < r.x1 <= 12 and r.y == 0 for r in spans)
    with pytest.raises(ValueError):
        temporal.temporal_filter(df, "other")


@pytest.fixture
def feed(spark, tmp_path):
    """Write frames as several files, oldest first, and stream them one file per batch."""

    def build(df, cuts):
        folder = str(tmp_path / "in")
        for low, high in zip(cuts, cuts[1:]):
            df.filter((F.col("frame_idx") >= low) & (F.col("frame_idx") < high)).coalesce(1).write.mode("append").parquet(folder)
            time.sleep(1.1)
        return stream_frames(spark, df.schema, folder, files_per_trigger=1)

    def run(stream):
        run_to_end(lossless_intake(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
        return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))

    return build, run, tmp_path


@pytest.mark.parametrize("mode", ["ema", "legacy"])
def test_stream_equals_batch_over_several_micro_batches(spark, feed, mode):
    build, run, _ = feed
    thumbs, maps, resized = sequence(60, 10)
    rows = frame_rows(thumbs, maps, resized) + frame_rows(thumbs[::-1], maps, resized, "h")
    df = spark.createDataFrame(rows, FRAMES)
    batch = temporal.smooth(df) if mode == "ema" else temporal.vote(df, 0.3)
    live = build(df.withColumn("run_id", F.lit("r1")), [0, 13, 14, 40, 60])
    out = run(filter_stream(live, mode, threshold=0.3)).orderBy("group", "frame_idx").collect()
    for a, b in zip(out, batch.orderBy("group", "frame_idx").collect(), strict=True):
        assert (a.group, a.frame_idx, a.was_reset) == (b.group, b.frame_idx, b.was_reset)
        np.testing.assert_allclose(a.p, b.p, atol=1e-14)


def test_a_new_run_of_a_source_starts_clean(spark, feed):
    build, run, _ = feed
    rows = [("g", i, 4, 4, 1, 1, [0.5], [0.9 if i < 2 else 0.2]) for i in range(4)]
    df = spark.createDataFrame(rows, FRAMES).withColumn("run_id", F.when(F.col("frame_idx") < 2, "a").otherwise("b"))
    out = run(filter_stream(build(df, [0, 1, 4]))).orderBy("frame_idx").collect()
    assert [r.was_reset for r in out] == [True, False, True, False]
    assert [round(r.p[0], 6) for r in out] == [0.9, 0.9, 0.2, 0.2]


def test_runs_of_a_source_alternate_and_go_on_after_a_restart(spark, feed, monkeypatch):
    build, run, _ = feed
    # State rows of eight bytes: a map is carried in several.
    monkeypatch.setattr("lanespan.streaming.temporal.CHUNK_BYTES", 8)
    rows = [("g", i, 4, 4, 1, 3, [0.5], [float(i % 2), 0.25, i / 8]) for i in range(8)]
    df = spark.createDataFrame(rows, FRAMES).withColumn("run_id", F.when(F.col("frame_idx") % 2 == 0, "a").otherwise("b"))
    run(filter_stream(build(df, [0, 4])))
    out = run(filter_stream(build(df, [4, 8]))).orderBy("frame_idx").collect()
    assert [r.was_reset for r in out] == [True, True] + 6 * [False]
    for k in (0, 1):
        carried = np.array(rows[k][-1])
        for r in out[k::2]:
            carried = carried if r.frame_idx == k else 0.7 * np.array(rows[r.frame_idx][-1]) + 0.3 * carried
            np.testing.assert_allclose(r.p, carried, atol=1e-14)


@pytest.mark.parametrize("mode", ["ema", "legacy", "none"])
def test_sources_that_share_a_lane_stay_apart(spark, feed, mode):
    build, run, _ = feed
    kinds = [sequence(24, 1 + k % 3, seed=k) for k in range(9)]
    rows = [r for k, (thumbs, maps, resized) in enumerate(kinds) for r in frame_rows(thumbs, maps, resized, f"s{k}")]
    df = spark.createDataFrame(rows, FRAMES)
    batch = {"ema": temporal.smooth, "legacy": lambda f: temporal.vote(f, 0.3), "none": lambda f: f}[mode](df)
    live = build(df.withColumn("run_id", F.lit("r1")), [0, 7, 8, 24])
    out = run(filter_stream(live, mode, threshold=0.3, lanes=1)).orderBy("group", "frame_idx").collect()
    for a, b in zip(out, batch.orderBy("group", "frame_idx").collect(), strict=True):
        assert (a.group, a.frame_idx, list(a.p)) == (b.group, b.frame_idx, list(b.p))
        assert mode == "none" or a.was_reset == b.was_reset
    with pytest.raises(ValueError):
        filter_stream(live, lanes=0)


def test_an_idle_run_is_forgotten(spark, feed):
    build, _, folder = feed
    rows = [("g", i, 4, 4, 1, 1, [0.5], [0.9]) for i in range(3)]
    df = spark.createDataFrame(rows, FRAMES).withColumn("run_id", F.lit("a"))
    live = filter_stream(build(df, [0, 1]), idle="3 seconds")
    query = lossless_intake(live, str(folder / "out"), str(folder / "cp")).trigger(processingTime="1 second").start()

    def reset(frame):
        for _ in range(120):
            if (folder / "out").exists():
                found = spark.read.schema(live.schema).parquet(str(folder / "out")).filter(F.col("frame_idx") == frame).collect()
                if found:
                    return found[0].was_reset
            time.sleep(0.5)
        raise AssertionError(f"frame {frame} never came out")

    try:
        assert reset(0)
        time.sleep(15)
        build(df, [1, 2])
        assert reset(1)
    finally:
        query.stop()


def test_a_step_back_is_refused(spark, feed):
    build, run, _ = feed
    rows = [("g", i, 4, 4, 1, 1, [0.5], [0.9]) for i in range(4)]
    df = spark.createDataFrame(rows, FRAMES).withColumn("run_id", F.lit("a"))
    df.filter("frame_idx > 1").coalesce(1).write.parquet(str(feed[2] / "in"))
    time.sleep(1.1)
    with pytest.raises(Exception, match="came after"):
        run(filter_stream(build(df, [0, 2])))
    with pytest.raises(ValueError):
        filter_stream(df, alpha=0)


def test_camera_intake_accounts_for_every_frame(spark, feed):
    build, _, folder = feed
    df = spark.createDataFrame([("g", i) for i in range(30)], "group string, frame_idx bigint")
    live = build(df, [0, 10, 11, 30])
    run_to_end(camera_intake(live, f"{folder}/kept", f"{folder}/ledger", f"{folder}/cp"))
    kept = sorted(r.frame_idx for r in spark.read.parquet(f"{folder}/kept").collect())
    assert kept == [8, 9, 10, 28, 29]
    assert spark.read.parquet(f"{folder}/ledger").agg(F.sum("frames_dropped")).first()[0] == 25


# ---------------------------------------------------------------- tracks

OBS = "group string, frame_idx bigint, height int, width int, reset boolean, dets array<struct<%s>>" % ", ".join(
    p.replace(" ", ":") for p in tracks.DETECTION.split(", ")
)


def branch(i, end=(20.0, 5.0), split=(60.0, 70.0), area=500.0, start=(60.0, 110.0)):
    d = np.subtract(end, split) / np.hypot(*np.subtract(end, split))
    return (i, *split, *start, *end, float(d[0]), float(d[1]), 70.0, 12.0, area)


FORK = [branch(0), branch(1, (100.0, 5.0), area=400.0)]


def observe(spark, frames, resets=()):
    return spark.createDataFrame([("g", i, 115, 128, i in resets, d) for i, d in enumerate(frames)], OBS)


def by_frame(df):
    out = {}
    for r in df.orderBy("frame_idx", "track_id").collect():
        out.setdefault(r.frame_idx, []).append(r)
    return out


def test_track_life_cycle(spark):
    frames = [FORK, FORK, FORK, [], FORK, [], [], [], [], FORK]
    found = by_frame(tracks.track_branches(observe(spark, frames)))
    states = {i: {r.state for r in rows} for i, rows in found.items()}
    assert states == {
        0: {"candidate"},
        1: {"candidate"},
        2: {"confirmed"},
        3: {"missing"},
        4: {"confirmed"},
        5: {"missing"},
        6: {"missing"},
        7: {"removed"},
        9: {"candidate"},
    }
    assert [r.confirmation_count for r in found[0]] == [1, 1] and [r.confirmation_count for r in found[4]] == [1, 1]
    assert {r.track_id for r in found[7]} == {1, 2} and {r.track_id for r in found[9]} == {3, 4}


def test_candidates_need_consecutive_frames_and_resets_restart(spark):
    found = by_frame(tracks.track_branches(observe(spark, [FORK, [], FORK])))
    assert {(r.state, r.confirmation_count) for r in found[2]} == {("candidate", 1)}
    again = by_frame(tracks.track_branches(observe(spark, [FORK] * 5, resets={3})))
    assert {r.state for r in again[3]} == {"candidate"} and {r.track_id for r in again[3]} == {1, 2}


def random_frames(n, seed):
    rng = np.random.default_rng(seed)
    quiet = rng.random(n) < 0.45
    frames = []
    for i in range(n):
        k = 0 if quiet[i] else rng.integers(0, 4)
        frames.append([branch(j, (float(rng.integers(0, 128)), float(rng.integers(0, 40))), area=float(rng.integers(1, 900))) for j in range(k)])
    return frames


def sequential(frames, resets):
    tracker, route, out = None, None, []
    for i, dets in enumerate(frames):
        if i == 0 or i in resets:
            tracker, route = tracks.Tracker(tracks.GeometryConfig()), tracks.Route()
        rows = tracker.step([dict(zip(tracks._FIELDS, d)) for d in dets], 115, 128)
        main = route.follow(rows)
        out += [(i, t["track_id"], t["state"], t["confirmation_count"], t["missed_frames"], t["det_idx"], main) for t in rows]
    return sorted(out, key=repr)


def flat(df):
    names = ("frame_idx", "track_id", "state", "confirmation_count", "missed_frames", "det_idx", "main_id")
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def test_cutting_a_source_does_not_change_its_tracks(spark):
    frames, resets = random_frames(250, 3), {60, 61, 180}
    observed = observe(spark, frames, resets)
    found = tracks.track_branches(observed)
    for block in (7, 4096):
        joined = found.join(tracks.choose_main(found, block), ["group", "frame_idx"])
        assert flat(joined) == sequential(frames, resets)


def busy_frames(n, seed):
    """Never blank for long enough to lose all tracks: slow branches, some of them missed now and then, and some noise."""
    rng = np.random.default_rng(seed)
    frames, ends = [], rng.uniform(10, 118, (4, 2)) * (1, 0.3)
    for _ in range(n):
        ends = np.clip(ends + rng.normal(0, 2.5, ends.shape), 1, (127, 38))
        ends[rng.random(4) < 0.01] = rng.uniform(5, 38, 2)
        seen = [tuple(e) for e in ends[rng.random(4) < 0.85]] or [tuple(ends[0])]
        frames.append([branch(j, e, area=float(rng.integers(1, 900))) for j, e in enumerate(seen)])
    return frames


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_blocks_start_from_a_guess_and_end_as_one_run(spark, size):
    frames, resets = busy_frames(600, 5), {150}
    found = tracks.track_branches(observe(spark, frames, resets), block=size)
    joined = found.join(tracks.choose_main(found, min(size, 256)), ["group", "frame_idx"])
    assert flat(joined) == sequential(frames, resets)


def test_wrong_guesses_are_run_again(spark, monkeypatch):
    """Without frames to guess from every block with live tracks is wrong at first."""
    monkeypatch.setattr(tracks, "WARMUP", 1)
    frames = busy_frames(120, 9)
    assert flat_tracks(tracks.track_branches(observe(spark, frames), block=11)) == [r[:-1] for r in sequential(frames, ())]


def flat_tracks(df):
    names = ("frame_idx", "track_id", "state", "confirmation_count", "missed_frames", "det_idx")
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def test_confirmed_flags_over_block_borders(spark):
    frames = busy_frames(90, 2)
    tracker, expected = tracks.Tracker(tracks.GeometryConfig(confirm_frames=6)), {}
    for i, dets in enumerate(frames):
        for t in tracker.step([dict(zip(tracks._FIELDS, d)) for d in dets], 115, 128):
            expected[i, t["track_id"]] = t["confirmed"]
    found = tracks.track_branches(observe(spark, frames), tracks.GeometryConfig(confirm_frames=6), block=4)
    assert {(r.frame_idx, r.track_id): r.confirmed for r in found.collect()} == expected


def test_track_stream_equals_sequential_run(spark, feed):
    build, run, _ = feed
    frames, resets = random_frames(50, 8), {20}
    live = build(observe(spark, frames, resets).withColumn("run_id", F.lit("r")), [0, 7, 21, 50])
    assert flat(run(track_stream(live))) == sequential(frames, resets)


def test_visible_routes(spark):
    found = tracks.track_branches(observe(spark, [FORK] * 3 + [[]]))
    mains = tracks.choose_main(found)
    main = by_frame(tracks.visible_routes(found, mains, "main"))
    shown = by_frame(tracks.visible_routes(found, mains, "all"))
    assert [len(main[i]) for i in range(4)] == [1, 1, 1, 1]
    assert [len(shown[i]) for i in range(4)] == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        tracks.visible_routes(found, mains, "some")


def test_detection_limits_and_duplicates(spark):
    config = tracks.GeometryConfig()
    rows = [(100, 200, 12.0, 10.0, 40.0), (100, 200, 11.9, 10.0, 40.0), (100, 200, 12.0, 9.9, 40.0), (100, 200, 12.0, 10.0, 39.0)]
    df = spark.createDataFrame(rows, "height int, width int, length double, width_px double, area double")
    assert tracks.branch_filter(df, config).count() == 1
    near = branch(2, (24.0, 5.0), area=450.0)
    kept = tracks.suppress_near_duplicates(observe(spark, [[*FORK, near]])).first().dets
    assert [d.det_idx for d in kept] == [0, 1]
    with pytest.raises(ValueError):
        tracks.GeometryConfig(match_distance=0)


def test_events_before_the_first_day_are_frames(spark, tmp_path):
    from lanespan.plans import views

    for name, days in {"before": ["2023-12-28", "2023-12-30"], "both": ["2023-12-30", "2024-01-02"]}.items():
        rows = [(k, 7, f"{d} 10:00:00", 3.0) for k, d in enumerate(days)]
        events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        events.write.parquet(str(tmp_path / name / "events.parquet"))
        found = {r.frame_idx: len(r.dets or []) for r in views.observations(spark, str(tmp_path / name)).collect()}
        assert found == ({-4: 1, -3: 0, -2: 1} if name == "before" else {-2: 1, -1: 0, 0: 0, 1: 1})


def test_track_stream_has_the_frames_before_the_first_day(spark, tmp_path):
    from lanespan.plans import QUERIES
    from lanespan.plans.temporal_queries import TRACK_COLUMNS

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 9 DAYS")).write.parquet(str(tmp_path / "events.parquet"))
    batch = {tuple(r) for r in QUERIES["track_branches"](spark, str(tmp_path)).collect()}
    stream = {tuple(r[n] for n in TRACK_COLUMNS) for r in QUERIES["track_stream"](spark, str(tmp_path)).collect()}
    assert stream == batch and min(r[1] for r in batch) < 0


def test_tracks_keep_their_detections_over_arrow_batches(spark):
    rng = np.random.default_rng(3)
    ends = [(float(rng.integers(0, 128)), float(rng.integers(0, 40))) for _ in range(6)]
    frames = [[branch(j, e) for j, e in enumerate(ends[: 2 + i % 3])] if i % 4 else [] for i in range(30)]
    df = spark.createDataFrame([("g", i, 100, 128, i == 17, d) for i, d in enumerate(frames)], OBS)

    def rows(size):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            return sorted(tracks.track_branches(df).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    whole = rows(10000)
    assert whole and rows(3) == whole and sorted(tracks.track_branches(df, block=4).collect()) == whole
    for r in whole:
        shown = frames[r.frame_idx - r.missed_frames][r.det_idx]
        assert (r.end_x, r.end_y, r.area) == (shown[5], shown[6], shown[11])


def test_detections_are_numbered_within_their_frame_array(spark):
    sf = "/root/testdata/sf0.001"
    seen = views.observations(spark, sf)
    assert "Window" not in seen._jdf.queryExecution().optimizedPlan().toString()
    listed = seen.select("group", "frame_idx", F.explode("dets").alias("d")).select("group", "frame_idx", "d.*")
    single = views.detections(spark, sf).select(*listed.columns)
    assert sorted(listed.collect()) == sorted(single.collect())


def test_the_stream_makes_no_table_per_frame(monkeypatch):
    """A table per frame costs more than the tracking; equal scores go to the first detection."""
    monkeypatch.setattr(tracks, "pd", None)
    seen = lambda k, number, end, missed=0: {
        "track_id": number, "det_idx": k, "missed_frames": missed, "state": "missing" if missed else "candidate", "area": 10.0,
        "start_x": 128.0, "start_y": 114.0, "end_x": end[0], "end_y": end[1],
    }
    route = tracks.Route()
    assert route.follow([seen(1, 1, (128.0, 20.0)), seen(0, 2, (128.0, 10.0))]) == 2
    assert (route.hx, route.hy) == (0.0, -1.0)
    assert route.follow([seen(0, 1, (128.0, 20.0)), seen(1, 2, (130.0, 10.0))]) == 2
    assert route.follow([seen(1, 2, (130.0, 10.0), missed=1)]) == 2
    assert route.follow([seen(0, 1, (128.0, 20.0), missed=1)]) is None
    assert route.follow([seen(0, 3, (128.0, 114.0))]) == 3 and (route.hx, route.hy) == (0.0, -1.0)
