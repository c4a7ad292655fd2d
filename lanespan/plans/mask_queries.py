"""Queries over masks: span algebra, morphology, components, zones, resizing, augmentation.

The comparison texts work on pixel sets, the Spark plans on spans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lanespan.functions import exprs
from lanespan.operators import augment, components, runs, zones
from lanespan.plans import views as v
from lanespan.plans.registry import query, rounded
from lanespan.plans.views import px, px_runs

TRUTH = px("t_px", "truth")
PRED = px("p_px", "pred")


def truth(spark, sf):
    return runs.merge_runs(v.raw_runs(spark, sf, "truth"))


def pred(spark, sf):
    return runs.merge_runs(v.raw_runs(spark, sf, "pred"))


def spans_of(pixels: str, *views: str, recursive: bool = False) -> str:
    return v.sql(v.MASKS, *views, px_runs("r", pixels), body="SELECT * FROM r", recursive=recursive)


# ---------------------------------------------------------------- span algebra

LOW_RUNS = """low_px AS (SELECT "group", frame_idx, y, x, p FROM map_px WHERE p >= 0.4),
low_isl AS (SELECT *, x - row_number() OVER (PARTITION BY "group", frame_idx, y ORDER BY x) AS isl FROM low_px),
low_runs AS (SELECT "group", frame_idx, y, min(x) AS x0, max(x) + 1 AS x1, max(p) AS peak FROM low_isl
             GROUP BY "group", frame_idx, y, isl)"""


@query(
    "pixels_to_runs",
    v.sql(
        v.PROB_MAPS,
        LOW_RUNS,
        body="""SELECT "group", frame_idx, y::INT AS y, x0::INT AS x0, x1::INT AS x1, round(peak, 6) AS peak FROM low_runs""",
    ),
)
def pixels_to_runs(spark, sf):
    return rounded(runs.pixels_to_runs(v.prob_maps(spark, sf), 0.4), "peak")


@query("merge_runs", spans_of("t_px", TRUTH))
def merge_runs(spark, sf):
    return truth(spark, sf)


@query(
    "intersect_runs",
    spans_of("both_px", TRUTH, PRED, "both_px AS (SELECT * FROM t_px INTERSECT SELECT * FROM p_px)"),
)
def intersect_runs(spark, sf):
    both = runs.intersect_runs(v.raw_runs(spark, sf, "truth"), v.raw_runs(spark, sf, "pred"))
    return runs.merge_runs(both)


@query(
    "subtract_runs",
    spans_of("only_px", TRUTH, PRED, "only_px AS (SELECT * FROM p_px EXCEPT SELECT * FROM t_px)"),
)
def subtract_runs(spark, sf):
    only = runs.subtract_runs(v.raw_runs(spark, sf, "pred"), v.raw_runs(spark, sf, "truth"))
    return runs.merge_runs(only)


ALL_PX = """all_px AS (SELECT "group", frame_idx, y, unnest(range(0, width)) AS x
  FROM (SELECT *, unnest(range(0, height)) AS y FROM dims))"""


@query(
    "complement_runs",
    spans_of("bg_px", PRED, ALL_PX, "bg_px AS (SELECT * FROM all_px EXCEPT SELECT * FROM p_px)"),
)
def complement_runs(spark, sf):
    return runs.complement_runs(pred(spark, sf), v.mask_dims(spark, sf))


# ---------------------------------------------------------------- morphology

ELLIPSE5 = """kernel AS (SELECT dy, unnest(range(-hw, hw + 1)) AS dx
  FROM (VALUES (-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)) AS k(dy, hw))"""
BOX3 = "box3 AS (SELECT dy, unnest(range(-1, 2)) AS dx FROM (VALUES (-1), (0), (1)) AS b(dy))"


def dilated(name: str, source: str, kernel: str = "kernel") -> str:
    return f"""{name} AS (SELECT DISTINCT "group", frame_idx, y + dy AS y, x + dx AS x FROM {source}, {kernel}
  WHERE y + dy BETWEEN 0 AND {v.MASK_H - 1} AND x + dx BETWEEN 0 AND {v.MASK_W - 1})"""


def eroded(name: str, source: str, kernel: str = "kernel") -> str:
    """Pixels none of whose neighbours inside the frame are background."""
    return f"""{name}_bg AS (SELECT * FROM all_px EXCEPT SELECT "group", frame_idx, y, x FROM {source}),
{dilated(f"{name}_hit", f"{name}_bg", kernel)},
{name} AS (SELECT * FROM all_px EXCEPT SELECT * FROM {name}_hit)"""


OPENED = (eroded("e1", "p_px"), dilated("o1", "e1"))
CLOSED_TWICE = (dilated("d1", "o1"), dilated("d2", "d1"), eroded("e2", "d2"), eroded("c2", "e2"))


@query("morphology_dilate", spans_of("d", PRED, ELLIPSE5, dilated("d", "p_px")))
def morphology_dilate(spark, sf):
    return runs.dilate_runs(pred(spark, sf), v.mask_dims(spark, sf), runs.ellipse_kernel(5))


@query("morphology_erode", spans_of("e", PRED, ALL_PX, ELLIPSE5, eroded("e", "p_px")))
def morphology_erode(spark, sf):
    return runs.erode_runs(pred(spark, sf), v.mask_dims(spark, sf), runs.ellipse_kernel(5))


@query(
    "morphology_close",
    spans_of("c", PRED, ALL_PX, ELLIPSE5, dilated("d", "p_px"), eroded("c", "d")),
)
def morphology_close(spark, sf):
    return runs.close_runs(pred(spark, sf), v.mask_dims(spark, sf), runs.ellipse_kernel(5))


@query("morphology_open", spans_of("o1", PRED, ALL_PX, ELLIPSE5, *OPENED))
def morphology_open(spark, sf):
    return runs.open_runs(pred(spark, sf), v.mask_dims(spark, sf), runs.ellipse_kernel(5))


@query("legacy_cleanup", spans_of("c2", PRED, ALL_PX, ELLIPSE5, *OPENED, *CLOSED_TWICE))
def legacy_cleanup(spark, sf):
    return runs.legacy_cleanup(pred(spark, sf), v.mask_dims(spark, sf))


@query(
    "smooth_mask",
    spans_of("o", PRED, ALL_PX, ELLIPSE5, dilated("d", "p_px"), eroded("c", "d"), eroded("e", "c"), dilated("o", "e")),
)
def smooth_mask(spark, sf):
    return runs.smooth_runs(pred(spark, sf), v.mask_dims(spark, sf))


BANDS = (
    BOX3,
    ALL_PX,
    eroded("ti", "t_px", "box3"),
    eroded("pi", "p_px", "box3"),
    *[
        f"""{m}_band AS (SELECT * FROM {m}_px EXCEPT SELECT * FROM {m}i
  WHERE y BETWEEN 1 AND {v.MASK_H - 2} AND x BETWEEN 1 AND {v.MASK_W - 2})"""
        for m in ("t", "p")
    ],
)


@query("boundary_band", spans_of("p_band", TRUTH, PRED, *BANDS))
def boundary_band(spark, sf):
    radius = runs.boundary_width(0.02)
    return runs.merge_runs(runs.boundary_band(pred(spark, sf), v.mask_dims(spark, sf), radius))


# ---------------------------------------------------------------- components


def components_sql(source: str, out: str) -> str:
    """SQL: 8-connected components of a span table by reachability between spans."""
    return f"""{out}_s AS (SELECT *, row_number() OVER (ORDER BY "group", frame_idx, y, x0) AS id FROM {source}),
{out}_e AS (SELECT a.id AS a, b.id AS b FROM {out}_s a JOIN {out}_s b ON a."group" = b."group" AND a.frame_idx = b.frame_idx
  AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
{out}_r AS (SELECT id AS root, id FROM {out}_s UNION SELECT r.root, e.b FROM {out}_r r JOIN {out}_e e ON e.a = r.id),
{out} AS (SELECT s.*, dense_rank() OVER (PARTITION BY s."group", s.frame_idx ORDER BY root) AS component
  FROM {out}_s s JOIN (SELECT id, min(root) AS root FROM {out}_r GROUP BY 1) USING (id))"""


P_RUNS = px_runs("p_runs", "p_px")
P_LABELS = (v.MASKS, PRED, P_RUNS, components_sql("p_runs", "lab"))


@query(
    "label_components",
    v.sql(*P_LABELS, body='SELECT "group", frame_idx, y, x0, x1, component::INT AS component FROM lab', recursive=True),
)
def label_components(spark, sf):
    return components.label_components(pred(spark, sf))


@query(
    "label_tiles",
    v.sql(*P_LABELS, body='SELECT "group", frame_idx, y, x0, x1, component::INT AS component FROM lab', recursive=True),
)
def label_tiles(spark, sf):
    """The same numbers from bands of seven rows."""
    return components.label_tiles(pred(spark, sf), 7)


LOWER = int(v.MASK_H * (1 - 0.20))
STATS = f"""stats AS (SELECT "group", frame_idx, component, sum(x1 - x0) AS area, min(y) AS top, max(y) AS bottom,
   max(y) >= {LOWER} AS touches_lower FROM lab GROUP BY 1, 2, 3),
lower_x AS (SELECT "group", frame_idx, component, avg(x) AS lower_mean_x FROM (
   SELECT DISTINCT "group", frame_idx, component, unnest(range(x0, x1)) AS x FROM lab WHERE y >= {LOWER}) GROUP BY 1, 2, 3)"""


@query(
    "component_stats",
    v.sql(
        *P_LABELS,
        STATS,
        body="""SELECT "group", frame_idx, component::INT AS component, area::BIGINT AS area, top, bottom, touches_lower,
  round(lower_mean_x, 6) AS lower_mean_x FROM stats LEFT JOIN lower_x USING ("group", frame_idx, component)""",
        recursive=True,
    ),
)
def component_stats(spark, sf):
    stats = components.component_stats(label_components(spark, sf), v.mask_dims(spark, sf))
    return rounded(stats, "lower_mean_x")


@query(
    "hysteresis",
    v.sql(
        v.PROB_MAPS,
        LOW_RUNS,
        components_sql("low_runs", "lab"),
        body="""SELECT "group", frame_idx, y::INT AS y, x0::INT AS x0, x1::INT AS x1 FROM lab
QUALIFY max(peak) OVER (PARTITION BY "group", frame_idx, component) >= 0.65""",
        recursive=True,
    ),
)
def hysteresis(spark, sf):
    return components.hysteresis(v.prob_maps(spark, sf))


HOLES = (
    v.MASKS,
    PRED,
    ALL_PX,
    "bg_px AS (SELECT * FROM all_px EXCEPT SELECT * FROM p_px)",
    px_runs("bg_runs", "bg_px"),
    components_sql("bg_runs", "hole"),
    f"""small AS (SELECT "group", frame_idx, component FROM hole GROUP BY 1, 2, 3
  HAVING sum(x1 - x0) <= {v.MASK_H * v.MASK_W} * 0.004::DOUBLE
     AND NOT bool_or(y = 0 OR y = {v.MASK_H - 1} OR x0 = 0 OR x1 = {v.MASK_W}))""",
    """filled_px AS (SELECT * FROM p_px UNION
  SELECT "group", frame_idx, y, unnest(range(x0, x1)) FROM hole JOIN small USING ("group", frame_idx, component))""",
    px_runs("filled", "filled_px"),
)


@query("fill_holes", v.sql(*HOLES, body="SELECT * FROM filled", recursive=True))
def fill_holes(spark, sf):
    return components.fill_small_holes(pred(spark, sf), v.mask_dims(spark, sf))


MIN_AREA = max(8, v.MASK_H * v.MASK_W // 700)
LEGACY_START = int(v.MASK_H * (1 - 0.42))
CHOSEN = """SELECT "group", frame_idx, y, x0, x1 FROM lab JOIN (
  SELECT "group", frame_idx, arg_max(component, (score, component)) AS component FROM scored GROUP BY 1, 2)
  USING ("group", frame_idx, component)"""


@query(
    "select_road",
    v.sql(
        *P_LABELS,
        f"""scored AS (SELECT "group", frame_idx, component, sum(x1 - x0) + 3 * (max(y) + 1) AS score FROM lab GROUP BY 1, 2, 3
  HAVING sum(x1 - x0) >= {MIN_AREA} AND max(y) + 1 >= {LEGACY_START})""",
        body=CHOSEN,
        recursive=True,
    ),
)
def select_road(spark, sf):
    return components.primary_component(label_components(spark, sf), v.mask_dims(spark, sf), MIN_AREA)


@query(
    "select_origin_road",
    v.sql(
        *P_LABELS,
        STATS,
        f"""scored AS (SELECT s."group", s.frame_idx, s.component, 4.0::DOUBLE * bottom / {v.MASK_H}
   - abs(lower_mean_x - {(v.MASK_W - 1) / 2}) / {v.MASK_W} + ln(1 + area) / 10 AS score
  FROM stats s JOIN lower_x USING ("group", frame_idx, component)
  WHERE touches_lower AND area >= greatest(4, {v.MASK_H * v.MASK_W} * 0.003::DOUBLE))""",
        body=CHOSEN,
        recursive=True,
    ),
)
def select_origin_road(spark, sf):
    return components.origin_component(label_components(spark, sf), v.mask_dims(spark, sf))


@query(
    "primary_road",
    v.sql(
        v.MASKS,
        PRED,
        ALL_PX,
        ELLIPSE5,
        *OPENED,
        *CLOSED_TWICE,
        px_runs("clean", "c2"),
        components_sql("clean", "lab"),
        f"""scored AS (SELECT "group", frame_idx, component, sum(x1 - x0) + 3 * (max(y) + 1) AS score FROM lab GROUP BY 1, 2, 3
  HAVING sum(x1 - x0) >= {MIN_AREA} AND max(y) + 1 >= {LEGACY_START})""",
        body=CHOSEN,
        recursive=True,
    ),
)
def primary_road(spark, sf):
    return components.primary_road(pred(spark, sf), v.mask_dims(spark, sf))



@query(
    "clean_road",
    v.sql(
        *HOLES,
        components_sql("filled", "lab"),
        STATS,
        f"""scored AS (SELECT s."group", s.frame_idx, s.component, 4.0::DOUBLE * bottom / {v.MASK_H}
   - abs(lower_mean_x - {(v.MASK_W - 1) / 2}) / {v.MASK_W} + ln(1 + area) / 10 AS score
  FROM stats s JOIN lower_x USING ("group", frame_idx, component)
  WHERE touches_lower AND area >= greatest(4, {v.MASK_H * v.MASK_W} * 0.003::DOUBLE))""",
        body=CHOSEN,
        recursive=True,
    ),
)
def clean_road(spark, sf):
    return components.clean_road(pred(spark, sf), v.mask_dims(spark, sf))


@query(
    "anchor_component",
    v.sql(
        *P_LABELS,
        """hit AS (SELECT DISTINCT "group", frame_idx, component FROM lab WHERE y = 35 AND 32 BETWEEN x0 AND x1 - 1)""",
        """scored AS (SELECT "group", frame_idx, component, (h.component IS NOT NULL, sum(x1 - x0), -component) AS score
  FROM lab LEFT JOIN hit h USING ("group", frame_idx, component) GROUP BY 1, 2, 3, h.component)""",
        body=CHOSEN,
        recursive=True,
    ),
)
def anchor_component(spark, sf):
    anchors = v.mask_dims(spark, sf).select("group", "frame_idx", F.lit(32).alias("ax"), F.lit(35).alias("ay"))
    return components.anchor_component(pred(spark, sf), anchors)


# ---------------------------------------------------------------- zones and forks

FULL = f"""cut AS (SELECT *, CASE WHEN x0 = 0 AND x1 <> {v.ROAD_W} THEN 'left' WHEN x1 = {v.ROAD_W} AND x0 <> 0 THEN 'right' END AS side
  FROM roads),
full_spans AS (SELECT * FROM roads WHERE x0 <> 0 AND x1 <> {v.ROAD_W}),
best AS (SELECT c."group", c.frame_idx, c.y, c.x0, c.x1, arg_min(f.x1 - f.x0, (3 * abs(f.y - c.y)
     + abs(CASE WHEN side = 'left' THEN f.x1 - c.x1 ELSE f.x0 - c.x0 END), f.y, f.x0)) AS w
  FROM cut c JOIN full_spans f ON c."group" = f."group" AND c.frame_idx = f.frame_idx AND abs(f.y - c.y) <= 100
  WHERE side IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
widths AS (SELECT "group", frame_idx, y, x0, x1, side AS cut_side,
     greatest(x1 - x0, coalesce(w, greatest(CAST(trunc((x1 - x0) * 1.5) AS INT), 32))) AS full_width
  FROM cut LEFT JOIN best USING ("group", frame_idx, y, x0, x1) WHERE side IS NOT NULL)"""

ZONED = f"""virtual AS (SELECT r.*, CASE WHEN cut_side = 'left' THEN x1 - full_width ELSE x0 END AS vl,
    CASE WHEN cut_side = 'right' THEN x0 + full_width ELSE x1 END AS vr
  FROM roads r LEFT JOIN widths USING ("group", frame_idx, y, x0, x1)),
band AS (SELECT *, greatest(vl + CAST(round_even((vr - vl) * (1.0::DOUBLE - 0.7::DOUBLE) / 2, 0) AS BIGINT), x0, 0) AS a,
    least(vr - CAST(round_even((vr - vl) * (1.0::DOUBLE - 0.7::DOUBLE) / 2, 0) AS BIGINT), x1, {v.ROAD_W}) AS b FROM virtual),
zoned AS (
  SELECT "group", frame_idx, y, a AS x0, b AS x1, 'center' AS zone FROM band WHERE a < b
  UNION ALL SELECT "group", frame_idx, y, x0, a, 'side' FROM band WHERE a < b AND x0 < a
  UNION ALL SELECT "group", frame_idx, y, b, x1, 'side' FROM band WHERE a < b AND b < x1
  UNION ALL SELECT "group", frame_idx, y, x0, x1, 'side' FROM band WHERE a >= b)"""


@query(
    "nearest_full_span",
    v.sql(v.ROADS, FULL, body='SELECT "group", frame_idx, y, x0, x1, cut_side, full_width FROM widths'),
)
def nearest_full_span(spark, sf):
    return zones.nearest_full_span(*v.roads(spark, sf))


@query("zone_runs", v.sql(v.ROADS, FULL, ZONED, body='SELECT "group", frame_idx, y, x0::INT AS x0, x1::INT AS x1, zone FROM zoned'))
def zone_runs(spark, sf):
    return zones.zone_runs(*v.roads(spark, sf))


@query(
    "zone_shares",
    v.sql(
        v.ROADS,
        FULL,
        ZONED,
        body="""SELECT "group", frame_idx, (sum(CASE zone WHEN 'center' THEN x1 - x0 ELSE 0 END))::BIGINT AS center_pixels,
  (sum(CASE zone WHEN 'side' THEN x1 - x0 ELSE 0 END))::BIGINT AS side_pixels,
  round(sum(CASE zone WHEN 'center' THEN x1 - x0 ELSE 0 END)::DOUBLE / sum(x1 - x0), 6) AS center_share
FROM zoned GROUP BY 1, 2""",
    ),
)
def zone_shares(spark, sf):
    return rounded(zones.zone_shares(zone_runs(spark, sf)), "center_share")


@query(
    "inner_outline",
    v.sql(
        v.ROADS,
        FULL,
        ZONED,
        BOX3,
        """c_px AS (SELECT "group", frame_idx, y, unnest(range(x0, x1)) AS x FROM zoned WHERE zone = 'center'),
near AS (SELECT DISTINCT "group", frame_idx, y + dy AS y, x + dx AS x FROM c_px, box3),
side_px AS (SELECT "group", frame_idx, y, unnest(range(x0, x1)) AS x FROM zoned WHERE zone = 'side'),
line_px AS (SELECT * FROM side_px INTERSECT SELECT * FROM near)""",
        px_runs("line", "line_px"),
        body="SELECT * FROM line",
    ),
)
def inner_outline(spark, sf):
    return zones.inner_outline(zone_runs(spark, sf))


SPLITS = f"""next_span AS (SELECT *, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1 FROM roads
  WINDOW w AS (PARTITION BY "group", frame_idx, y ORDER BY x0)),
split_rows AS (SELECT DISTINCT "group", frame_idx, y FROM next_span
  WHERE nx0 - x1 >= 16 AND x1 - x0 >= 20 AND nx1 - nx0 >= 20),
streaks AS (SELECT "group", frame_idx, count(*) AS n FROM (
    SELECT *, y - row_number() OVER (PARTITION BY "group", frame_idx ORDER BY y) AS isl FROM split_rows)
  GROUP BY "group", frame_idx, isl),
persistent AS (SELECT s."group", s.frame_idx, coalesce(max(n), 0) AS longest_streak, coalesce(max(n), 0) >= 12 AS is_split
  FROM shapes s LEFT JOIN streaks USING ("group", frame_idx) GROUP BY 1, 2)"""


@query("persistent_split", v.sql(v.ROADS, SPLITS, body="SELECT * FROM persistent"))
def persistent_split(spark, sf):
    return zones.persistent_split(*v.roads(spark, sf))


@query(
    "branch_connectors",
    v.sql(
        v.ROADS,
        SPLITS,
        f"""per_row AS (SELECT "group", frame_idx, y, count(*) AS n, min(x0) AS l, max(x1) AS r FROM roads GROUP BY 1, 2, 3),
ends AS (SELECT p.* FROM per_row p JOIN persistent USING ("group", frame_idx)
  LEFT JOIN per_row q ON q."group" = p."group" AND q.frame_idx = p.frame_idx AND q.y = p.y + 1
  WHERE is_split AND p.n >= 2 AND coalesce(q.n, 0) < 2 AND p.y < {v.ROAD_H - 1}),
parents AS (SELECT e."group", e.frame_idx, e.y, min(p.y) AS py FROM ends e JOIN per_row p ON p."group" = e."group"
  AND p.frame_idx = e.frame_idx AND p.n = 1 AND p.y BETWEEN e.y + 1 AND e.y + 79 GROUP BY 1, 2, 3)""",
        body="""SELECT a."group", a.frame_idx, ((p.l + p.r) // 2)::INT AS parent_x, p.y::INT AS parent_y,
  ((a.x0 + a.x1) // 2)::INT AS child_x, a.y::INT AS child_y,
  greatest(3, CAST(round_even(least(a.x1 - a.x0, p.r - p.l) * 0.12::DOUBLE, 0) AS INT)) AS thickness
FROM parents k JOIN roads a ON a."group" = k."group" AND a.frame_idx = k.frame_idx AND a.y = k.y
JOIN per_row p ON p."group" = k."group" AND p.frame_idx = k.frame_idx AND p.y = k.py""",
    ),
)
def branch_connectors(spark, sf):
    return zones.branch_connectors(*v.roads(spark, sf))


# ---------------------------------------------------------------- resizing and augmentation

CANVAS_W, CANVAS_H = 48, 32


def plans(spark, sf):
    plan = exprs.letterbox_plan("height", "width", CANVAS_W, CANVAS_H, 0.2)
    return v.mask_dims(spark, sf).select("group", "frame_idx", plan.alias("plan"))


# For the 36 x 64 masks: crop 7 rows, scale 29 x 64 to 22 x 48, centre with 5 rows above.
CANVAS_PX = """canvas_px AS (SELECT g AS "group", f AS frame_idx, dy + 5 AS y, dx AS x
  FROM (SELECT "group" AS g, frame_idx AS f, unnest(range(0, 22)) AS dy FROM dims), (SELECT unnest(range(0, 48)) AS dx)
  SEMI JOIN p_px ON p_px."group" = g AND p_px.frame_idx = f AND p_px.y = 7 + dy * 29 // 22 AND p_px.x = dx * 64 // 48)"""


@query("canvas_runs", spans_of("canvas_px", PRED, CANVAS_PX))
def canvas_runs(spark, sf):
    return runs.merge_runs(runs.apply_mask(pred(spark, sf), plans(spark, sf)))


@query(
    "restore_runs",
    spans_of(
        "back_px",
        PRED,
        CANVAS_PX,
        """back_px AS (SELECT g AS "group", f AS frame_idx, oy + 7 AS y, ox AS x
  FROM (SELECT "group" AS g, frame_idx AS f, unnest(range(0, 29)) AS oy FROM dims), (SELECT unnest(range(0, 64)) AS ox)
  SEMI JOIN canvas_px c ON c."group" = g AND c.frame_idx = f AND c.y = 5 + oy * 22 // 29 AND c.x = ox * 48 // 64)""",
    ),
)
def restore_runs(spark, sf):
    plan = plans(spark, sf)
    return runs.merge_runs(runs.restore_runs(runs.apply_mask(pred(spark, sf), plan), plan))


def uniform_sql(name: str) -> str:
    key = f"""sha256('42|' || "group" || '|' || frame_idx || '|{name}')"""
    return f"(('0x' || substr({key}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


AUGMENT = f"""plan AS (SELECT "group", frame_idx, height AS h, width AS w, {uniform_sql("use_flip")} < 0.5 AS flip,
  {uniform_sql("use_crop")} < 0.2 AS crop, 0.8::DOUBLE + {uniform_sql("crop_fraction")} * 0.2::DOUBLE AS f FROM dims),
sized AS (SELECT *, greatest(1, CAST(trunc(h * f) AS INT)) AS ch, greatest(1, CAST(trunc(w * f) AS INT)) AS cw FROM plan),
placed AS (SELECT *, CAST(floor({uniform_sql("crop_top")} * (h - ch + 1)) AS INT) AS ct,
  CAST(floor({uniform_sql("crop_left")} * (w - cw + 1)) AS INT) AS cl FROM sized)"""


@query(
    "flip_runs",
    spans_of(
        "f_px",
        PRED,
        AUGMENT,
        """f_px AS (SELECT "group", frame_idx, y, CASE WHEN flip THEN w - 1 - x ELSE x END AS x
  FROM p_px JOIN placed USING ("group", frame_idx))""",
    ),
)
def flip_runs(spark, sf):
    plan = augment.geometric_plan(v.mask_dims(spark, sf)).withColumn("crop", F.lit(False))
    return runs.merge_runs(runs.augment_runs(pred(spark, sf), plan))


@query(
    "augment_runs",
    spans_of(
        "a_px",
        PRED,
        AUGMENT,
        """target AS (SELECT *, unnest(range(0, w)) AS x FROM (SELECT *, unnest(range(0, h)) AS y FROM placed)),
looked AS (SELECT "group" AS g, frame_idx AS fi, y AS ty, x AS tx,
    CASE WHEN crop THEN ct + y * ch // h ELSE y END AS sy,
    CASE WHEN crop THEN cl + x * cw // w ELSE x END AS sx, flip, w FROM target),
a_px AS (SELECT g AS "group", fi AS frame_idx, ty AS y, tx AS x FROM looked
  SEMI JOIN p_px ON p_px."group" = g AND p_px.frame_idx = fi AND p_px.y = sy
   AND p_px.x = CASE WHEN flip THEN w - 1 - sx ELSE sx END)""",
    ),
)
def augment_runs(spark, sf):
    plan = augment.geometric_plan(v.mask_dims(spark, sf))
    return runs.merge_runs(runs.augment_runs(pred(spark, sf), plan))


def _frames(spark, sf):
    pixels = F.transform("p", lambda x: F.floor(x * 255))
    return v.prob_maps(spark, sf).withColumns({"pixels": pixels, "channels": F.lit(1)}).drop("p")


@query(
    "photometric",
    v.sql(
        v.PROB_MAPS,
        f"""tone AS (SELECT "group", frame_idx, {uniform_sql("use_tone")} < 0.7 AS used,
  0.75::DOUBLE + {uniform_sql("gain")} * (1.25::DOUBLE - 0.75::DOUBLE) AS gain,
  -0.12::DOUBLE + {uniform_sql("offset")} * (0.12::DOUBLE - -0.12::DOUBLE) AS offs,
  0.7::DOUBLE + {uniform_sql("gamma")} * (1.4::DOUBLE - 0.7::DOUBLE) AS gamma
  FROM (SELECT DISTINCT "group", frame_idx FROM map_px)),
toned AS (SELECT "group", frame_idx, y, x, CASE WHEN used
    THEN pow(greatest(0, least(1, floor(p * 255) / 255.0::DOUBLE * gain + offs)), gamma)
    ELSE floor(p * 255) / 255.0::DOUBLE END AS value FROM map_px JOIN tone USING ("group", frame_idx))""",
        body="""SELECT "group", frame_idx, list(CAST(floor(greatest(0, least(1, value)) * 255) AS INT) ORDER BY y, x) AS augmented
FROM toned GROUP BY 1, 2""",
    ),
)
def photometric(spark, sf):
    toned = augment.photometric_augment(_frames(spark, sf), 42, ("tone",))
    return toned.select("group", "frame_idx", "augmented")


@query("photometric_all")
def photometric_all(spark, sf):
    return augment.photometric_augment(_frames(spark, sf), 42).select("group", "frame_idx", "augmented")
