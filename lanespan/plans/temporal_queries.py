"""Queries over ordered frames: scenes, smoothing, voting, detections, tracks, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanespan.operators import temporal, tracks
from lanespan.plans import views as v
from lanespan.plans.registry import query
from lanespan.session import materialize, shared_folder
from lanespan.sources.frames import stream_frames
from lanespan.streaming.intake import camera_intake, camera_totals, lossless_intake, run_to_end
from lanespan.streaming.temporal import filter_stream, span_intake
from lanespan.streaming.tracks import track_stream

SCENES = """changed AS (SELECT *, coalesce(abs(thumb - lag(thumb) OVER (PARTITION BY "group" ORDER BY frame_idx)) > 0.25, true) AS was_reset
  FROM frames_seq),
scenes AS (SELECT *, sum(was_reset::INT) OVER (PARTITION BY "group" ORDER BY frame_idx) AS segment FROM changed)"""

EMA = """ema AS (
  SELECT "group", frame_idx, was_reset, p, p AS s FROM changed WHERE frame_idx = 0
  UNION ALL
  SELECT c."group", c.frame_idx, c.was_reset, c.p, CASE WHEN c.was_reset THEN c.p ELSE 0.7::DOUBLE * c.p + 0.3::DOUBLE * e.s END
  FROM ema e JOIN changed c ON c."group" = e."group" AND c.frame_idx = e.frame_idx + 1)"""


@query(
    "scene_segments",
    v.sql(v.FRAMES_SEQ, SCENES, body='SELECT "group", frame_idx, was_reset, segment::BIGINT AS segment FROM scenes'),
)
def scene_segments(spark, sf):
    return temporal.scene_segments(v.frames_seq(spark, sf))


SMOOTHED = v.sql(
    v.FRAMES_SEQ,
    SCENES,
    EMA,
    body='SELECT "group", frame_idx, was_reset, round(s + 1.2345e-9::DOUBLE, 6) AS p FROM ema',
    recursive=True,
)


def _one_pixel(df, shift: float = 0.0, *more: str):
    """The pixel as a number; ``shift`` moves smoothed values off decimal ties before rounding."""
    value = F.round(F.get("p", F.lit(0)) + F.lit(shift), 6)
    return df.select("group", *more, "frame_idx", "was_reset", value.alias("p"))


@query("ema", SMOOTHED)
def ema(spark, sf):
    return _one_pixel(temporal.smooth(v.frames_seq(spark, sf)), 1.2345e-9)


VOTED = v.sql(
    v.FRAMES_SEQ,
    SCENES,
    """votes AS (SELECT *, sum((p >= 0.15)::INT) OVER (PARTITION BY "group", segment ORDER BY frame_idx
    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM scenes)""",
    body="""SELECT "group", frame_idx, was_reset, CASE WHEN p >= 0.15 AND n >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM votes""",
)


@query("vote", VOTED)
def vote(spark, sf):
    return _one_pixel(temporal.vote(v.frames_seq(spark, sf), threshold=0.15))


def kept(value: str) -> str:
    return f"""SELECT "group", frame_idx, 0 AS y, 0 AS x0, 1 AS x1 FROM {value}"""


@query(
    "ema_hysteresis",
    v.sql(v.FRAMES_SEQ, SCENES, EMA, body=kept("ema WHERE s >= 0.65"), recursive=True),
)
def ema_hysteresis(spark, sf):
    return temporal.temporal_filter(v.frames_seq(spark, sf), "ema")


@query("plain_hysteresis", v.sql(v.FRAMES_SEQ, body=kept("frames_seq WHERE p >= 0.65")))
def plain_hysteresis(spark, sf):
    return temporal.temporal_filter(v.frames_seq(spark, sf), "none")


# ---------------------------------------------------------------- detections and tracks


@query(
    "branch_filter",
    v.sql(
        v.DETECTIONS,
        body="""SELECT "group", frame_idx, det_idx::INT AS det_idx, round(length, 6) AS length, round(width_px, 6) AS width_px,
  round(area, 6) AS area FROM detections
WHERE length >= 0.12::DOUBLE * height AND width_px >= 0.05::DOUBLE * width AND area >= 0.002::DOUBLE * height * width""",
    ),
)
def branch_filter(spark, sf):
    kept_rows = tracks.branch_filter(v.detections(spark, sf))
    return kept_rows.select(
        "group", "frame_idx", "det_idx", *[F.round(c, 6).alias(c) for c in ("length", "width_px", "area")]
    )


SUPPRESSED = (
    v.DETECTIONS,
    """ranked AS (SELECT *, CASE WHEN length = 0 THEN 0 ELSE (end_x - 128) / length END AS dx,
    CASE WHEN length = 0 THEN -1 ELSE (end_y - 80) / length END AS dy,
    row_number() OVER (PARTITION BY "group", frame_idx ORDER BY area DESC, det_idx) AS r FROM detections)""",
    """clashes AS (SELECT a."group", a.frame_idx, a.r, a.det_idx, list(b.r) FILTER (b.r IS NOT NULL) AS rivals
  FROM ranked a LEFT JOIN ranked b ON b."group" = a."group" AND b.frame_idx = a.frame_idx AND b.r < a.r
    AND degrees(acos(greatest(-1.0, least(1.0, a.dx * b.dx + a.dy * b.dy)))) < 25 GROUP BY 1, 2, 3, 4)""",
    """greedy AS (
  SELECT "group", frame_idx, r, [r] AS kept FROM clashes WHERE r = 1
  UNION ALL
  SELECT c."group", c.frame_idx, c.r, CASE WHEN list_has_any(g.kept, coalesce(c.rivals, [])) THEN g.kept ELSE list_append(g.kept, c.r) END
  FROM greedy g JOIN clashes c ON c."group" = g."group" AND c.frame_idx = g.frame_idx AND c.r = g.r + 1)""",
    """final AS (SELECT "group", frame_idx, unnest(kept) AS r FROM greedy
  QUALIFY row_number() OVER (PARTITION BY "group", frame_idx ORDER BY greedy.r DESC) = 1)""",
)


@query(
    "suppress_duplicates",
    v.sql(
        *SUPPRESSED,
        body="""SELECT "group", frame_idx, det_idx::INT AS det_idx FROM final JOIN ranked USING ("group", frame_idx, r)""",
        recursive=True,
    ),
)
def suppress_duplicates(spark, sf):
    kept_rows = tracks.suppress_near_duplicates(v.observations(spark, sf))
    each = kept_rows.select("group", "frame_idx", F.explode_outer("dets").alias("d")).filter("d IS NOT NULL")
    return each.select("group", "frame_idx", "d.det_idx")


def _tracked(spark, sf):
    return tracks.track_branches(tracks.suppress_near_duplicates(v.observations(spark, sf)))


TRACK_COLUMNS = ("group", "frame_idx", "track_id", "det_idx", "state", "confirmed", "confirmation_count", "missed_frames")


# A source's live tracks are a list that each frame turns into the next one. Pairs are taken by cost: the fold's first element holds the
# pairs taken so far. ``after`` has the tracks of a frame, dead ones last time; ``main`` follows the best one seen.
FRAME_STEP = """shown AS (
  SELECT "group", frame_idx, list({'d': det_idx::INT, 'ex': end_x, 'ey': end_y, 'dx': dx, 'dy': dy, 'area': area,
    'hx': CASE WHEN hyp > 0 THEN (end_x - 128) / hyp ELSE 0 END, 'hy': CASE WHEN hyp > 0 THEN (end_y - 114) / hyp ELSE -1 END} ORDER BY r) AS dets
  FROM (SELECT *, sqrt((end_x - 128) * (end_x - 128) + (end_y - 114) * (end_y - 114)) AS hyp FROM final JOIN ranked USING ("group", frame_idx, r))
  GROUP BY 1, 2),
days AS (SELECT least(min(frame_idx), 0) AS first, max(frame_idx) AS last FROM detections),
observed AS (
  SELECT "group", frame_idx, coalesce(dets, []) AS dets
  FROM (SELECT "group", unnest(generate_series(first, last)) AS frame_idx FROM (SELECT DISTINCT "group" FROM detections), days)
  LEFT JOIN shown USING ("group", frame_idx)),
tracked AS (
  SELECT DISTINCT "group", first - 1 AS frame_idx, 1::BIGINT AS next_id,
    []::STRUCT(id BIGINT, n INT, ok BOOLEAN, missed INT, det STRUCT(d INT, ex DOUBLE, ey DOUBLE, dx DOUBLE, dy DOUBLE, area DOUBLE, hx DOUBLE, hy DOUBLE))[] AS after,
    NULL::BIGINT AS followed, 0::DOUBLE AS hx, (-1)::DOUBLE AS hy, NULL::BIGINT AS main_id
  FROM detections, days
  UNION ALL
  SELECT "group", frame_idx, next_id + len(fresh), list_concat(moved, fresh) AS after,
    coalesce(best.id, followed), coalesce(best.det.hx, hx), coalesce(best.det.hy, hy),
    CASE WHEN best IS NOT NULL THEN best.id WHEN len(list_filter(moved, lambda t: t.id = followed AND t.missed <= 2)) > 0 THEN followed END
  FROM (
    SELECT *, list_sort(list_transform(list_filter(list_concat(moved, fresh), lambda t: t.missed = 0),
        lambda t: {'s': -(t.det.hx * hx + t.det.hy * hy + CASE WHEN t.id IS NOT DISTINCT FROM followed THEN 0.3::DOUBLE ELSE 0::DOUBLE END
                          + 0.05::DOUBLE * ln(1 + t.det.area)), 'd': t.det.d, 't': t}))[1].t AS best
    FROM (
      SELECT *, list_transform(live, lambda t, i: CASE
          WHEN len(list_filter(taken, lambda p: p.i = i)) = 0 THEN {'id': t.id, 'n': 0, 'ok': t.ok, 'missed': t.missed + 1, 'det': t.det}
          ELSE {'id': t.id, 'n': CASE WHEN t.missed = 0 THEN t.n + 1 ELSE 1 END, 'ok': t.ok OR (t.missed = 0 AND t.n + 1 >= 3), 'missed': 0,
                'det': dets[list_filter(taken, lambda p: p.i = i)[1].j]} END) AS moved,
        list_transform(list_filter(list_transform(dets, lambda d, j: {'j': j, 'd': d}), lambda x: len(list_filter(taken, lambda p: p.j = x.j)) = 0),
          lambda x, k: {'id': next_id + k - 1, 'n': 1, 'ok': false, 'missed': 0, 'det': x.d}) AS fresh
      FROM (
        SELECT *, list_reduce(list_concat([{'c': -1::DOUBLE, 'i': 0, 'j': 0, 'held': []::STRUCT(i BIGINT, j BIGINT)[]}],
            list_sort(list_filter(pairs, lambda p: p.c IS NOT NULL))),
          lambda a, p: CASE WHEN len(list_filter(a.held, lambda h: h.i = p.i OR h.j = p.j)) > 0 THEN a
            ELSE {'c': a.c, 'i': a.i, 'j': a.j, 'held': list_append(a.held, {'i': p.i, 'j': p.j})} END).held AS taken
        FROM (
          SELECT *, flatten(list_transform(live, lambda t, i: list_transform(dets, lambda d, j: {
              'c': CASE WHEN sqrt((t.det.ex - d.ex) ** 2 + (t.det.ey - d.ey) ** 2) / 256 <= 0.18::DOUBLE
                     AND 1 - greatest(-1::DOUBLE, least(1::DOUBLE, t.det.dx * d.dx + t.det.dy * d.dy)) < 0.8::DOUBLE
                   THEN sqrt((t.det.ex - d.ex) ** 2 + (t.det.ey - d.ey) ** 2) / 256
                     + 0.12::DOUBLE * (1 - greatest(-1::DOUBLE, least(1::DOUBLE, t.det.dx * d.dx + t.det.dy * d.dy))) END,
              'i': i, 'j': j, 'held': []::STRUCT(i BIGINT, j BIGINT)[]}))) AS pairs
          FROM (
            SELECT o."group", o.frame_idx, o.dets, s.next_id, s.followed, s.hx, s.hy, list_filter(s.after, lambda t: t.missed <= 2) AS live
            FROM tracked s JOIN observed o ON o."group" = s."group" AND o.frame_idx = s.frame_idx + 1)))))),
track_rows AS (
  SELECT "group", frame_idx, main_id, t.id AS track_id, t.det.d AS det_idx,
    CASE WHEN t.missed > 2 THEN 'removed' WHEN t.missed > 0 THEN 'missing' WHEN t.ok THEN 'confirmed' ELSE 'candidate' END AS state,
    t.ok AS confirmed, t.n AS confirmation_count, t.missed AS missed_frames
  FROM (SELECT "group", frame_idx, main_id, unnest(after) AS t FROM tracked))"""


def tracked_sql(body: str) -> str:
    return v.sql(*SUPPRESSED, FRAME_STEP, body=body, recursive=True)


def routes_sql(shown: str) -> str:
    return tracked_sql(
        f"""SELECT "group", frame_idx, track_id, state, coalesce(track_id = main_id, false) AS is_main FROM track_rows WHERE {shown}"""
    )


TRACK_LIST = ", ".join(f'"{c}"' for c in TRACK_COLUMNS)


@query("track_branches", tracked_sql(f"SELECT {TRACK_LIST} FROM track_rows"))
def track_branches(spark, sf):
    return _tracked(spark, sf).select(*TRACK_COLUMNS)


@query("choose_main", tracked_sql("""SELECT "group", frame_idx, main_id FROM tracked WHERE len(after) > 0"""))
def choose_main(spark, sf):
    return tracks.choose_main(_tracked(spark, sf))


def _routes(spark, sf, mode):
    tracked = _tracked(spark, sf)
    shown = tracks.visible_routes(tracked, tracks.choose_main(tracked), mode)
    return shown.select("group", "frame_idx", "track_id", "state", "is_main")


@query("visible_routes", routes_sql("coalesce(track_id = main_id, false) OR (confirmed AND state <> 'removed')"))
def visible_routes(spark, sf):
    return _routes(spark, sf, "all")


@query("main_routes", routes_sql("track_id = main_id"))
def main_routes(spark, sf):
    return _routes(spark, sf, "main")


# ---------------------------------------------------------------- streams

# A live source numbers its frames by arrival; the event number is that order here.
ARRIVED = """arrived AS (SELECT 'trip' || user_id AS "group", event_id AS frame_idx, value / 491 AS thumb,
  least(value, 100.0) / 100 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
stepped AS (SELECT *, coalesce(abs(thumb - lag(thumb) OVER (PARTITION BY "group" ORDER BY n)) > 0.25, true) AS was_reset FROM arrived)"""


CHUNKS = 4


def _arrivals(spark, sf, folder):
    """Write the events chunk by chunk, the older first, and stop after each.

    A source's part of a chunk is one file; a stream reads older files first.
    """
    events = v.table(spark, sf, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    width = ((high or 0) - (low or 0)) // CHUNKS + 1
    for k in range(CHUNKS):
        begin = (low or 0) + k * width
        chunk = events.filter(F.col("event_id").between(begin, begin + width - 1))
        chunk.repartition("user_id").write.mode("append").parquet(folder)
        yield k


def _event_frames(spark, sf, folder):
    """Stream of the events that lie in a folder."""
    return stream_frames(spark, v.table(spark, sf, "events").schema, folder, files_per_trigger=64)


def _event_stream(spark, sf):
    """Events in the order of arrival, whatever files the table has."""
    folder = shared_folder(spark, "arrivals")
    for _ in _arrivals(spark, sf, folder):
        pass
    return _event_frames(spark, sf, folder)


def _live_frames(spark, sf, events=None, run=None):
    one = F.lit(1)
    return (_event_stream(spark, sf) if events is None else events).select(
        F.concat(F.lit("trip"), F.col("user_id")).alias("group"),
        (F.lit("live") if run is None else run).alias("run_id"),
        F.col("event_id").alias("frame_idx"),
        *[one.alias(n) for n in ("height", "width", "p_height", "p_width")],
        F.array(F.col("value") / 491).alias("thumb"),
        F.array(F.least(F.col("value"), F.lit(100.0)) / 100).alias("p"),
    )


def _through_stream(spark, frames, name):
    """Run a stream over what is available and hand back the table it wrote."""
    folder = shared_folder(spark, name)
    run_to_end(lossless_intake(frames, f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.schema(frames.schema).parquet(f"{folder}/out")


@query(
    "ema_stream",
    v.sql(
        ARRIVED,
        """live AS (
  SELECT "group", frame_idx, n, was_reset, p AS s FROM stepped WHERE n = 1
  UNION ALL
  SELECT c."group", c.frame_idx, c.n, c.was_reset, CASE WHEN c.was_reset THEN c.p ELSE 0.7::DOUBLE * c.p + 0.3::DOUBLE * e.s END
  FROM live e JOIN stepped c ON c."group" = e."group" AND c.n = e.n + 1)""",
        body='SELECT "group", frame_idx, was_reset, round(s + 1.2345e-9::DOUBLE, 6) AS p FROM live',
        recursive=True,
    ),
)
def ema_stream(spark, sf):
    return _one_pixel(_through_stream(spark, filter_stream(_live_frames(spark, sf)), "ema"), 1.2345e-9)


@query(
    "ema_runs_stream",
    v.sql(
        """arrived AS (SELECT 'trip' || user_id AS "group", CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run_id,
  event_id AS frame_idx, value / 491 AS thumb, least(value, 100.0) / 100 AS p,
  row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS n FROM events)""",
        """stepped AS (SELECT *, coalesce(abs(thumb - lag(thumb) OVER (PARTITION BY "group", run_id ORDER BY n)) > 0.25, true) AS was_reset
  FROM arrived)""",
        """live AS (
  SELECT "group", run_id, frame_idx, n, was_reset, p AS s FROM stepped WHERE n = 1
  UNION ALL
  SELECT c."group", c.run_id, c.frame_idx, c.n, c.was_reset,
    CASE WHEN c.was_reset THEN c.p ELSE 0.7::DOUBLE * c.p + 0.3::DOUBLE * e.s END
  FROM live e JOIN stepped c ON c."group" = e."group" AND c.run_id = e.run_id AND c.n = e.n + 1)""",
        body='SELECT "group", run_id, frame_idx, was_reset, round(s + 1.2345e-9::DOUBLE, 6) AS p FROM live',
        recursive=True,
    ),
)
def ema_runs_stream(spark, sf):
    """Two runs of every source at once; the stream ends in the middle of the table and goes on from its checkpoint."""
    arrivals, folder = shared_folder(spark, "arrivals"), shared_folder(spark, "runs")
    run = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    for k in _arrivals(spark, sf, arrivals):
        if k in (CHUNKS // 2 - 1, CHUNKS - 1):
            smoothed = filter_stream(_live_frames(spark, sf, _event_frames(spark, sf, arrivals), run))
            run_to_end(lossless_intake(smoothed, f"{folder}/out", f"{folder}/checkpoint"))
    out = spark.read.schema(smoothed.schema).parquet(f"{folder}/out")
    return _one_pixel(out, 1.2345e-9, "run_id")


@query(
    "vote_stream",
    v.sql(
        ARRIVED,
        """scened AS (SELECT *, sum(was_reset::INT) OVER (PARTITION BY "group" ORDER BY n) AS segment FROM stepped)""",
        """votes AS (SELECT *, sum((p >= 0.15)::INT) OVER (PARTITION BY "group", segment ORDER BY n
    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS k FROM scened)""",
        body="""SELECT "group", frame_idx, was_reset, CASE WHEN p >= 0.15 AND k >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM votes""",
    ),
)
def vote_stream(spark, sf):
    voted = filter_stream(_live_frames(spark, sf), mode="legacy", threshold=0.15)
    return _one_pixel(_through_stream(spark, voted, "vote"))


@query("ema_spans_stream", v.sql(v.FRAMES_SEQ, SCENES, EMA, body=kept("ema WHERE s >= 0.65"), recursive=True))
def ema_spans_stream(spark, sf):
    """Road spans out of the stream, equal to those of the batch."""
    folder = shared_folder(spark, "frames")
    frames = materialize(v.frames_seq(spark, sf).withColumn("run_id", F.lit("live")))
    last = frames.agg(F.max("frame_idx")).first()[0] or 0
    width = last // CHUNKS + 1
    for begin in range(0, last + 1, width):
        chunk = frames.filter(F.col("frame_idx").between(begin, begin + width - 1))
        chunk.repartition("group").write.mode("append").parquet(f"{folder}/in")
    live = stream_frames(spark, frames.schema, f"{folder}/in", files_per_trigger=64)
    run_to_end(span_intake(filter_stream(live), f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query(
    "lossless_stream",
    v.sql(ARRIVED, body='SELECT "group", frame_idx, round(p, 6) AS p FROM arrived'),
)
def lossless_stream(spark, sf):
    frames = _live_frames(spark, sf).select("group", "frame_idx", F.round(F.get("p", F.lit(0)), 6).alias("p"))
    return _through_stream(spark, frames, "lossless")


@query(
    "camera_stream",
    v.sql(
        ARRIVED,
        body="""SELECT "group", count(*) AS frames_read, least(count(*), 2) AS frames_processed,
  greatest(count(*) - 2, 0) AS frames_dropped, max(frame_idx) AS newest FROM arrived GROUP BY 1""",
    ),
)
def camera_stream(spark, sf):
    folder = shared_folder(spark, "camera")
    kept_path, ledger_path = f"{folder}/kept", f"{folder}/ledger"
    frames = _live_frames(spark, sf).select("group", "frame_idx")
    run_to_end(camera_intake(frames, kept_path, ledger_path, f"{folder}/checkpoint"))
    return camera_totals(spark.read.parquet(kept_path), spark.read.parquet(ledger_path))


@query("track_stream", tracked_sql(f"SELECT {TRACK_LIST}, main_id FROM track_rows"))
def track_stream_query(spark, sf):
    """Tracks from a stream of observations arriving week by week, equal to the batch result.

    A week is written after the one before and a source's week is one file, so files in arrival
    order hold each source's frames in order, however many a micro-batch takes.
    """
    folder = shared_folder(spark, "observations")
    observed = materialize(
        tracks.suppress_near_duplicates(v.observations(spark, sf)).withColumn("run_id", F.lit("live"))
    )
    begin, last = (day or 0 for day in observed.agg(F.min("frame_idx"), F.max("frame_idx")).first())
    for first in range(begin, last + 1, 8):
        week = observed.filter(F.col("frame_idx").between(first, first + 7))
        week.repartition("group").write.mode("append").parquet(f"{folder}/in")
    live = stream_frames(spark, observed.schema, f"{folder}/in", files_per_trigger=64)
    return _through_stream(spark, track_stream(live), "tracks").select(*TRACK_COLUMNS, "main_id")
