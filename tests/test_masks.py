"""Mask operators against plain loops over pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanespan.functions.exprs import letterbox_plan
from lanespan.operators import augment, components, runs, zones
from lanespan.plans import views
from tests.conftest import DIMS, RUNS, spans_of

SHAPES = [(9, 14), (12, 10), (7, 7), (16, 20), (11, 30), (20, 9)]


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(3)
    made = [rng.random(s) < d for s, d in zip(SHAPES, (0.5, 0.7, 0.3, 0.85, 0.6, 0.9))]
    made[2][:] = False
    made[5][:] = True
    return made


def grow(mask, kernel):
    out = np.zeros_like(mask)
    h, w = mask.shape
    for y, x in zip(*np.nonzero(mask)):
        for dy, hw in kernel:
            if 0 <= y + dy < h:
                out[y + dy, max(0, x - hw) : min(w, x + hw + 1)] = True
    return out


def shrink(mask, kernel):
    return ~grow(~mask, kernel)


def flood(mask):
    """8-connected labels in order of first pixel."""
    labels = np.zeros(mask.shape, int)
    count = 0
    for start in zip(*np.nonzero(mask)):
        if labels[start]:
            continue
        count += 1
        stack = [start]
        while stack:
            y, x = stack.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not labels[y, x]:
                labels[y, x] = count
                stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return labels


def same(found, expected):
    for f, e in zip(found, expected):
        np.testing.assert_array_equal(f, e)


def test_merge_collapses_overlaps_and_copies(spark):
    rows = [("g", 0, 3, a, b) for a, b in [(0, 4), (2, 6), (6, 8), (10, 12), (11, 11)]] * 50
    merged = runs.merge_runs(spark.createDataFrame(rows, RUNS)).orderBy("x0").collect()
    assert [(r.x0, r.x1) for r in merged] == [(0, 8), (10, 12)]


def test_complement(mask_table, to_masks, masks):
    table, dims = mask_table(masks)
    same(to_masks(runs.complement_runs(table, dims), SHAPES), [~m for m in masks])


@pytest.mark.parametrize("size", [1, 3, 5])
def test_morphology_matches_pixel_loops(mask_table, to_masks, masks, size):
    table, dims = mask_table(masks)
    k = runs.ellipse_kernel(size)
    same(to_masks(runs.dilate_runs(table, dims, k), SHAPES), [grow(m, k) for m in masks])
    same(to_masks(runs.erode_runs(table, dims, k), SHAPES), [shrink(m, k) for m in masks])
    same(to_masks(runs.open_runs(table, dims, k), SHAPES), [grow(shrink(m, k), k) for m in masks])
    same(
        to_masks(runs.close_runs(table, dims, k, 2), SHAPES),
        [shrink(shrink(grow(grow(m, k), k), k), k) for m in masks],
    )


def test_ellipse_rows():
    assert runs.ellipse_kernel(5) == [(-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)]
    assert runs.ellipse_kernel(3) == [(-1, 0), (0, 1), (1, 0)]
    with pytest.raises(ValueError):
        runs.ellipse_kernel(4)


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 7])
def test_boundary_band_of_any_width(mask_table, to_masks, radius):
    rng = np.random.default_rng(radius)
    made = []
    for h, w in SHAPES:
        m = np.ones((h + 14, w + 14), bool)
        m[rng.integers(0, h + 14, 3), rng.integers(0, w + 14, 3)] = False
        made.append(m)
    shapes = [m.shape for m in made]
    table, dims = mask_table(made)
    box = [(dy, radius) for dy in range(-radius, radius + 1)]
    expected = []
    for m in made:
        padded = np.pad(m, radius)
        expected.append(m & ~shrink(padded, box)[radius:-radius, radius:-radius])
    band = runs.merge_runs(runs.boundary_band(table, dims, radius))
    same(to_masks(band, shapes), expected)


def test_boundary_width_rounds_half_even_and_has_a_minimum(spark):
    dims = spark.createDataFrame([(48, 80), (1080, 1920)], "height int, width int")
    assert [r[0] for r in dims.select(runs.boundary_width(0.01)).collect()] == [1, 22]
    assert [r[0] for r in dims.select(runs.boundary_width(0.02)).collect()] == [2, 44]
    with pytest.raises(ValueError):
        runs.boundary_width(0)


def test_every_frame_has_its_own_radius_kernel_and_area(spark, mask_table, to_masks):
    rng = np.random.default_rng(11)
    shapes = [(12, 16), (40, 100), (90, 70), (130, 125)]
    made = []
    for h, w in shapes:
        m = np.ones((h, w), bool)
        for y, x in zip(rng.integers(0, h, 9), rng.integers(0, w, 9)):
            m[y : y + 2, x : x + 3] = False
        made.append(m)
    table, dims = mask_table(made)
    bands, closed = [], []
    for m in made:
        h, w = m.shape
        radius = max(1, round(0.04 * (h * h + w * w) ** 0.5))
        padded = np.pad(m, radius)
        box = [(dy, radius) for dy in range(-radius, radius + 1)]
        bands.append(m & ~shrink(padded, box)[radius:-radius, radius:-radius])
        diameter = max(1, round(min(h, w) * 0.025))
        kernel = runs.ellipse_kernel(diameter + 1 - diameter % 2)
        closed.append(shrink(grow(m, kernel), kernel))
    assert len({runs.ellipse_kernel(max(1, round(min(s) * 0.025)) | 1)[0] for s in shapes}) > 1
    band = runs.merge_runs(runs.boundary_band(table, dims, runs.boundary_width(0.04)))
    same(to_masks(band, shapes), bands)
    same(to_masks(runs.close_gaps(table, dims), shapes), closed)
    areas = dims.orderBy("frame_idx").select(components.default_min_area()).collect()
    assert [r[0] for r in areas] == [max(8, h * w // 700) for h, w in shapes]


def test_components_match_flood_fill(mask_table, masks):
    spiral = np.zeros((15, 15), bool)
    spiral[0] = spiral[:, 14] = spiral[14] = True
    spiral[2:, 0] = spiral[2, :13] = spiral[2:13, 12] = True
    made = [*masks, spiral]
    table, _ = mask_table(made)
    found = [np.zeros(m.shape, int) for m in made]
    for r in components.label_components(table).collect():
        found[r.frame_idx][r.y, r.x0 : r.x1] = r.component
    same(found, [flood(m) for m in made])


def test_components_survive_batches_that_split_a_frame(spark, mask_table):
    rng = np.random.default_rng(0)
    made = [rng.random((12, 12)) < 0.55 for _ in range(30)]
    table, _ = mask_table(made)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = components.label_components(table).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = [np.zeros(m.shape, int) for m in made]
    for r in rows:
        found[r.frame_idx][r.y, r.x0 : r.x1] = r.component
    same(found, [flood(m) for m in made])


def test_small_holes_are_filled_and_border_gaps_kept(mask_table, to_masks):
    road = np.ones((40, 50), bool)
    road[10:12, 10:13] = False  # 6 pixels, enclosed
    road[20:30, 20:30] = False  # too large
    road[0, 5] = False  # at the border
    table, dims = mask_table([road])
    filled = to_masks(components.fill_small_holes(table, dims), [road.shape])[0]
    expected = road.copy()
    expected[10:12, 10:13] = True
    np.testing.assert_array_equal(filled, expected)


def test_road_selection_policies(mask_table, to_masks):
    mask = np.zeros((100, 80), bool)
    mask[5:35, 5:75] = True  # large but far above the lower part
    mask[60:100, 30:50] = True  # road
    mask[90:96, 2:6] = True  # small
    table, dims = mask_table([mask, np.zeros((100, 80), bool)])
    labelled = components.label_components(table)
    expected = np.zeros_like(mask)
    expected[60:100, 30:50] = True
    for chosen in (
        components.primary_component(labelled, dims, 11),
        components.origin_component(labelled, dims),
    ):
        found = to_masks(chosen, [mask.shape] * 2)
        np.testing.assert_array_equal(found[0], expected)
        assert not found[1].any()


def test_component_stats_count_columns_once(mask_table):
    mask = np.zeros((10, 12), bool)
    mask[6:10, 2:5] = True
    mask[9, 2:9] = True
    table, dims = mask_table([mask])
    row = components.component_stats(components.label_components(table), dims).first()
    assert (row.area, row.top, row.bottom, row.touches_lower) == (16, 6, 9, True)
    assert row.lower_mean_x == np.mean(range(2, 9))


def test_anchor_keeps_the_component_under_it_or_the_largest(spark, mask_table, to_masks):
    mask = np.zeros((10, 10), bool)
    mask[0:3, 0:3] = mask[6:10, 5:10] = True
    table, _ = mask_table([mask, mask])
    anchors = spark.createDataFrame([("g", 0, 1, 1), ("g", 1, None, None)], "group string, frame_idx long, ax int, ay int")
    kept = to_masks(components.anchor_component(table, anchors), [mask.shape] * 2)
    assert kept[0].sum() == 9 and kept[0][1, 1]
    assert kept[1].sum() == 20 and kept[1][7, 7]


def test_letterbox_plan_values(spark):
    sizes = spark.createDataFrame([(360, 640), (640, 360), (2, 1)], "h int, w int")
    rows = sizes.select(letterbox_plan("h", "w", 256, 144).alias("p")).select("p.*").collect()
    assert (rows[0].roi_y, rows[0].content_width, rows[0].content_height, rows[0].left) == (72, 256, 115, 0)
    assert rows[0].top == 14
    assert rows[1].roi_y == 128 and rows[1].content_height == 144 and rows[1].content_width == 101
    assert rows[2].content_width >= 1 and rows[2].content_height >= 1
    with pytest.raises(ValueError):
        letterbox_plan("h", "w", 250, 144)
    with pytest.raises(ValueError):
        letterbox_plan("h", "w", 192, 192, 0.2, preprocess_version=0)


def test_canvas_round_trip(mask_table, to_masks):
    wedge, block = np.zeros((360, 640), bool), np.zeros((360, 640), bool)
    for y in range(72, 360):
        wedge[y, 320 - (y - 60) // 2 : 320 + (y - 60) // 2] = True
    block[72:, 180:460] = True
    table, dims = mask_table([wedge, block])
    plans = dims.select("group", "frame_idx", letterbox_plan("height", "width", 256, 144).alias("plan"))
    plan = plans.first().plan
    small = runs.apply_mask(table, plans)
    canvases = to_masks(small, [(144, 256)] * 2)
    restored = to_masks(runs.restore_runs(small, plans), [(360, 640)] * 2)
    content = to_masks(runs.restore_runs(runs.unpad_runs(small, plans), plans, already_unpadded=True), [(360, 640)] * 2)
    rows = 72 + np.arange(plan.content_height) * 288 // plan.content_height
    back = plan.top + np.arange(288) * plan.content_height // 288
    for mask, canvas, full, same_full in zip((wedge, block), canvases, restored, content):
        inside = canvas[plan.top : plan.top + plan.content_height]
        np.testing.assert_array_equal(inside, mask[rows][:, np.arange(256) * 640 // 256])
        assert canvas.sum() == inside.sum() and not full[:72].any()
        np.testing.assert_array_equal(full[72:], canvas[back][:, np.arange(640) * 256 // 640])
        np.testing.assert_array_equal(full, same_full)
    assert (restored[1] & block).sum() / (restored[1] | block).sum() > 0.985
    wrong = runs.apply_mask(table, plans.withColumn("plan", F.col("plan").withField("original_height", F.lit(300))))
    with pytest.raises(Exception, match="outside the shape"):
        wrong.collect()


def test_padding_never_becomes_road(spark, mask_table, to_masks):
    _, dims = mask_table([np.zeros((360, 640), bool)])
    plans = dims.select("group", "frame_idx", letterbox_plan("height", "width", 256, 144).alias("plan"))
    full = spark.createDataFrame(spans_of(np.ones((144, 256), bool), 0), RUNS)
    back = to_masks(runs.restore_runs(full, plans), [(360, 640)])[0]
    assert back[72:].all() and not back[:72].any()
    plan = plans.first().plan
    padding = np.ones((144, 256), bool)
    padding[plan.top : plan.top + plan.content_height, plan.left : plan.left + plan.content_width] = False
    assert runs.restore_runs(spark.createDataFrame(spans_of(padding, 0), RUNS), plans).isEmpty()


def test_spans_outside_their_shape_stop_the_job(spark):
    dims = spark.createDataFrame([("g", 0, 36, 64)], DIMS)
    plans = dims.select("group", "frame_idx", letterbox_plan("height", "width", 48, 32).alias("plan"))
    for row in ((36, 0, 5), (-1, 0, 5), (5, -1, 5), (5, 60, 65)):
        bad = spark.createDataFrame([("g", 0, *row)], RUNS)
        for move in (runs.apply_mask, runs.unpad_runs, runs.restore_runs):
            with pytest.raises(Exception, match="outside the shape"):
                move(bad, plans).collect()
        with pytest.raises(Exception, match="outside the shape"):
            runs.restore_runs(bad, plans, already_unpadded=True).collect()


def test_augmentation_keeps_masks_binary_and_negatives_empty(spark, mask_table, to_masks):
    rng = np.random.default_rng(5)
    made = [rng.random((24, 32)) < (0 if i % 3 == 0 else 0.6) for i in range(30)]
    table, dims = mask_table(made)
    plan = augment.geometric_plan(dims)
    found = to_masks(runs.merge_runs(runs.augment_runs(table, plan)), [m.shape for m in made])
    for p in plan.collect():
        m = made[p.frame_idx][:, ::-1] if p.flip else made[p.frame_idx]
        if p.crop:
            m = m[p.crop_top : p.crop_top + p.crop_h, p.crop_left : p.crop_left + p.crop_w]
            m = m[np.arange(24) * p.crop_h // 24][:, np.arange(32) * p.crop_w // 32]
        np.testing.assert_array_equal(found[p.frame_idx], m)
        assert found[p.frame_idx].any() == made[p.frame_idx].any() or p.crop


def test_photometric_effects_stay_in_range(spark):
    row = ("g", 4, 5, 3, [float(i % 256) for i in range(60)])
    rows = [(*row[:1], i, *row[1:]) for i in range(40)]
    frames = spark.createDataFrame(rows, "group string, frame_idx long, height int, width int, channels int, pixels array<double>")
    out = augment.photometric_augment(frames).select("augmented").collect()
    again = augment.photometric_augment(frames.repartition(3)).orderBy("frame_idx").select("augmented").collect()
    assert sorted(out) == sorted(again)
    assert all(len(r.augmented) == 60 and 0 <= min(r.augmented) and max(r.augmented) <= 255 for r in out)
    assert len({tuple(r.augmented) for r in out}) > 20


# ---------------------------------------------------------------- zones


def fork(h=144, w=256, split=72):
    mask = np.zeros((h, w), bool)
    mask[split:, 108:148] = True
    for y in range(split):
        d = 32 + (split - y) // 3
        mask[y, 128 - d - 20 : 128 - d + 20] = mask[y, 128 + d - 20 : 128 + d + 20] = True
    return mask


def full_width(spans, y, side, x0, x1, h, w):
    best = None
    for cy in range(max(0, y - min(100, h - 1)), min(h, y + min(100, h - 1) + 1)):
        for a, b in spans[cy]:
            if a and b != w:
                key = (3 * abs(cy - y) + abs((b - x1) if side == "left" else (a - x0)), cy, a)
                if best is None or key < best[0]:
                    best = (key, b - a)
    return max(x1 - x0, best[1] if best else max(int((x1 - x0) * 1.5), 32))


@pytest.mark.parametrize("seed", range(3))
def test_nearest_full_span_equals_full_search(spark, seed):
    rng = np.random.default_rng(seed)
    h, w = 130, 90
    mask = np.zeros((h, w), bool)
    for y in range(h):
        for a in np.sort(rng.choice(w, 3, replace=False)):
            if rng.random() < 0.5:
                mask[y, a : a + rng.integers(1, 25)] = True
        if rng.random() < 0.3:
            mask[y, : rng.integers(1, 20)] = True
    rows = spans_of(mask, 0)
    spans = {y: [] for y in range(h)}
    for _, _, y, a, b in rows:
        spans[y].append((a, b))
    expected = {}
    for _, _, y, a, b in rows:
        if (a == 0) != (b == w):
            side = "left" if a == 0 else "right"
            expected[y, a, b] = full_width(spans, y, side, a, b, h, w)
    dims = spark.createDataFrame([("g", 0, h, w)], DIMS)
    found = zones.nearest_full_span(spark.createDataFrame(rows, RUNS), dims).collect()
    assert {(r.y, r.x0, r.x1): r.full_width for r in found} == expected


def test_clipped_span_without_any_full_span(spark):
    table = spark.createDataFrame([("g", 0, 2, 0, 10), ("g", 0, 3, 30, 64)], RUNS)
    dims = spark.createDataFrame([("g", 0, 8, 64)], DIMS)
    widths = {r.y: r.full_width for r in zones.nearest_full_span(table, dims).collect()}
    assert widths == {2: 32, 3: 51}


def test_zone_center_share_and_bounds(mask_table):
    cross = np.zeros((480, 480), bool)
    cross[:, 200:280] = True
    cross[200:280, :] = True
    table, dims = mask_table([cross])
    zoned = zones.zone_runs(table, dims)
    painted = np.zeros((480, 480), int)
    for r in zoned.collect():
        painted[r.y, r.x0 : r.x1] += 1
    np.testing.assert_array_equal(painted, cross.astype(int))
    share = zones.zone_shares(zoned).first().center_share
    assert abs(share - 0.70) < 0.03
    with pytest.raises(ValueError):
        zones.zone_runs(table, dims, 1.2)


def test_persistent_split_and_connectors(mask_table):
    noise = np.zeros((144, 256), bool)
    noise[:, 90:160] = True
    noise[40:45, 110:130] = False  # too short
    table, dims = mask_table([fork(), noise])
    split = {r.frame_idx: r for r in zones.persistent_split(table, dims).collect()}
    assert split[0].is_split and split[0].longest_streak == 72
    assert not split[1].is_split
    lines = zones.branch_connectors(table, dims).orderBy("child_x").collect()
    assert [(r.frame_idx, r.parent_x, r.parent_y, r.child_x, r.child_y, r.thickness) for r in lines] == [
        (0, 128, 72, 96, 71, 5),
        (0, 128, 72, 160, 71, 5),
    ]


@pytest.mark.parametrize("band", [1, 3, 64])
def test_bands_give_the_components_of_whole_frames(spark, mask_table, band):
    """Noise, a spiral through all bands, a comb whose teeth meet in the last row, and a frame without spans."""
    rng = np.random.default_rng(band)
    spiral = np.zeros((41, 41), bool)
    y, x, dy, dx, left = 20, 20, 0, 1, 1
    for turn in range(38):
        for _ in range(left):
            spiral[y, x] = True
            y, x = y + dy, x + dx
        dy, dx = dx, -dy
        left += turn % 2
    comb = np.zeros((30, 601), bool)
    comb[:, ::2] = True
    comb[:-1, 1::2] = False
    comb[-1, :300] = True
    table, _ = mask_table([rng.random((25, 700)) < 0.35, spiral, comb, np.zeros((5, 5), bool), rng.random((9, 9)) < 0.6])
    whole = {(r.frame_idx, r.y, r.x0): r.component for r in components.label_components(table).collect()}
    tiled = components.label_tiles(table.withColumn("extra", F.col("x0") * 2), band, ["extra"]).collect()
    assert {(r.frame_idx, r.y, r.x0): r.component for r in tiled} == whole and all(r.extra == 2 * r.x0 for r in tiled)
    assert components.label_tiles(table.limit(0), band).collect() == []


def test_one_very_large_frame_is_many_tasks(spark):
    """20,000 x 20,000 pixels: two ladders of spans that meet at the bottom, and single spots between them."""
    rows = spark.range(0, 20_000, 4).selectExpr("'g' AS group", "0L AS frame_idx", "cast(id AS int) AS top")
    pieces = "array(struct(top AS y, 0 AS x0, 9000 AS x1), struct(top AS y, 11000 AS x0, 20000 AS x1), struct(top AS y, 10000 AS x0, 10001 AS x1))"
    rungs = rows.selectExpr("group", "frame_idx", f"explode({pieces}) AS s").selectExpr("group", "frame_idx", "s.*")
    posts = spark.range(20_000).selectExpr("'g' AS group", "0L AS frame_idx", "cast(id AS int) AS y", "explode(array(0, 19999)) AS x0")
    posts = posts.filter("y % 4 <> 0 AND y < 19999").selectExpr("group", "frame_idx", "y", "x0", "x0 + 1 AS x1")
    last = spark.createDataFrame([("g", 0, 19_999, 0, 20_000)], "group string, frame_idx bigint, y int, x0 int, x1 int")
    found = components.label_tiles(rungs.unionByName(posts).unionByName(last), 1000)
    sizes = {r.component: r["count"] for r in found.groupBy("component").count().collect()}
    # The ladders are one by the last row; the spots in every fourth row are one each.
    assert len(sizes) == 5001 and sizes[1] == 10_000 + 2 * (20_000 - 5_000 - 1) + 1 and sizes[2] == 1


def test_road_frames_are_placed_by_their_number(spark, tmp_path, monkeypatch):
    """A frame becomes hundreds of spans, so the few bytes of its supplier must not put all frames into one task."""
    rows = [(i, "s", i % 25, 0.0) for i in range(64)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(views, "ROAD_FRAMES", 4)
    table, dims = views.roads(spark, str(tmp_path))
    place = lambda df: df.select("frame_idx", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in place(table)}) > 8
    assert len(place(table)) == 64
    assert len({r.p for r in place(zones.split_rows(table, dims))}) > 8


def test_equal_clipped_spans_stay(spark):
    table = spark.createDataFrame([("g", 0, 2, 0, 10), ("g", 0, 2, 0, 10), ("g", 0, 3, 5, 45)], RUNS)
    dims = spark.createDataFrame([("g", 0, 8, 64)], DIMS)
    assert [(r.y, r.full_width) for r in zones.nearest_full_span(table, dims).collect()] == [(2, 40), (2, 40)]
