"""Frames, masks, samples and telemetry derived from the test tables.

Every view exists twice: as a Spark plan and as SQL text for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanespan.functions.ordered import even_width, with_position
from lanespan.operators.tracks import fill_blank

MASK_H, MASK_W = 36, 64
ROAD_H, ROAD_W = 144, 256
#: Road frames of one partition.
ROAD_FRAMES = 512
MAP_SIDE = 8
DET_H, DET_W = 115, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, name: str = "ts") -> Column:
    """Microseconds since the epoch, whatever the session time zone."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})")
    return F.unix_micros(F.col(name))


def _positions(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rank rows by (us, event_id) within keys, cut into time buckets of similar size."""
    width = even_width(rows, "us")
    return with_position(rows, keys, ["us", "event_id"], F.floor(F.col("us") / F.lit(width)), name)


# ---------------------------------------------------------------- frames and telemetry


def frames_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event is one frame of its user's trip, with a one-pixel probability map."""
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.concat(F.lit("trip"), F.col("user_id")).alias("group"), micros(events).alias("us"), "event_id", "value"
    )
    one = F.lit(1)
    return _positions(rows, ["group"], "frame_idx").select(
        "group",
        "frame_idx",
        *[one.alias(n) for n in ("height", "width", "p_height", "p_width")],
        F.array(F.col("value") / 491).alias("thumb"),
        F.array(F.least(F.col("value"), F.lit(100.0)) / 100).alias("p"),
    )


FRAMES_SEQ = """frames_seq AS (
  SELECT 'trip' || user_id AS "group",
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         value / 491 AS thumb, least(value, 100.0) / 100 AS p
  FROM events)"""

STAGE_OF = {"click": "read", "error": "prepare", "purchase": "inference", "signup": "temporal", "view": "render"}


def stage_of(event_type: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in STAGE_OF.items() for x in pair])[F.col(event_type)]


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select(
        (F.col("user_id") % 10).alias("run_id"), micros(events).alias("us"), "event_id", "event_type", "value"
    )
    placed = _positions(rows, ["run_id"], "_pos")
    return placed.select(
        "run_id",
        F.floor(F.col("_pos") / 4).cast("long").alias("frame_seq"),
        stage_of("event_type").alias("stage"),
        (F.col("value") / 1000).alias("seconds"),
        (F.col("us") / 1e6).alias("t"),
        F.col("value").alias("ms"),
        "event_id",
    )


def completions(timed: DataFrame) -> DataFrame:
    return timed.groupBy("run_id", "frame_seq").agg(
        F.min("t").alias("captured_at"), F.max("t").alias("completed_at")
    )


TIMED = """timed AS (
  SELECT user_id % 10 AS run_id,
         (row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1) // 4 AS frame_seq,
         CASE event_type WHEN 'click' THEN 'read' WHEN 'error' THEN 'prepare' WHEN 'purchase' THEN 'inference'
              WHEN 'signup' THEN 'temporal' WHEN 'view' THEN 'render' END AS stage,
         value / 1000 AS seconds, epoch_us(ts) / 1e6 AS t, value AS ms, event_id
  FROM events)"""

COMPLETIONS = """completions AS (
  SELECT run_id, frame_seq, min(t) AS captured_at, max(t) AS completed_at FROM timed GROUP BY 1, 2)"""


# ---------------------------------------------------------------- samples


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents play labelled images; their source is the trip they were taken on."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = documents.select("doc_id", "text", "lang", "source").join(
        labels.select("doc_id", "quality", "toxic"), "doc_id", "left"
    )
    number = F.col("doc_id").cast("string")
    return joined.select(
        F.col("source").alias("group"),
        F.concat(F.lit("img/"), number).alias("image"),
        F.concat(F.lit("mask/"), number).alias("mask"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("image_hash"),
        F.sha2(F.concat("lang", F.coalesce(F.col("quality"), F.lit(-1)).cast("string")).cast("binary"), 256).alias(
            "mask_hash"
        ),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("negative"),
        "lang",
        "quality",
        "toxic",
    )


SAMPLES = """samples AS (
  SELECT d.source AS "group", 'img/' || d.doc_id AS image, 'mask/' || d.doc_id AS mask,
         sha256(d.text) AS image_hash, sha256(d.lang || coalesce(l.quality, -1)) AS mask_hash,
         coalesce(l.quality = 0, false) AS negative, d.lang, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

ASSIGNED = """assigned AS (
  SELECT "group", CASE WHEN pos < tr THEN 'train' WHEN pos < tr + va THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT "group", row_number() OVER (ORDER BY sha256('42|' || "group"), "group") - 1 AS pos
        FROM (SELECT DISTINCT "group" FROM samples)),
       (SELECT n - 2 * greatest(1, CAST(trunc(n * 0.15::DOUBLE) AS BIGINT)) AS tr,
               greatest(1, CAST(trunc(n * 0.15::DOUBLE) AS BIGINT)) AS va
        FROM (SELECT count(DISTINCT "group") AS n FROM samples))),
split_samples AS (SELECT s.*, a.split FROM samples s JOIN assigned a USING ("group"))"""

FILES = """files AS (
  SELECT source AS "group", 'image' AS kind, 'img/' || sha256(text) || '.png' AS path FROM documents
  UNION ALL
  SELECT d.source, 'mask', 'mask/' || sha256(d.text) || '_mask.png'
  FROM documents d JOIN labels l USING (doc_id)
  UNION ALL
  SELECT 'src' || (page_id % 20), 'mask', 'mask/page' || page_id || '_mask.PNG' FROM pages),
stems AS (
  SELECT *, CASE WHEN kind = 'image' THEN regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '')
            ELSE regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', ''), '_mask$', '') END AS stem
  FROM files),
pairs AS (
  SELECT "group", stem, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'mask') AS masks,
         min(path) FILTER (kind = 'image') AS image, min(path) FILTER (kind = 'mask') AS mask
  FROM stems GROUP BY 1, 2)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files for documents, mask files for labelled ones, and masks without image."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("group"), F.sha2(F.encode("text", "utf-8"), 256).alias("stem")
    )
    labelled = documents.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    pages = table(spark, sf_dir, "pages")
    path = lambda a, b, c: F.concat(F.lit(a), b, F.lit(c)).alias("path")
    stem = F.col("stem")
    return (
        documents.select("group", F.lit("image").alias("kind"), path("img/", stem, ".png"))
        .unionByName(labelled.select("group", F.lit("mask").alias("kind"), path("mask/", stem, "_mask.png")))
        .unionByName(
            pages.select(
                F.concat(F.lit("src"), F.col("page_id") % 20).alias("group"),
                F.lit("mask").alias("kind"),
                path("mask/page", F.col("page_id"), "_mask.PNG"),
            )
        )
    )


# ---------------------------------------------------------------- artifacts


def artifact_members(samples_df: DataFrame) -> DataFrame:
    """One artifact per language: which groups and contents it was trained, tuned and calibrated on."""
    c = F.col
    use = F.when(c("toxic") == 1, "training").when(c("quality") == 0, "validation").when(c("quality") == 1, "calibration")
    pieces = F.explode(
        F.array(
            F.struct(F.concat("use", F.lit("_groups")).alias("field"), c("group").alias("value")),
            F.struct(F.concat("use", F.lit("_image_hashes")).alias("field"), c("image_hash").alias("value")),
        )
    ).alias("m")
    used = samples_df.withColumn("use", use).filter(c("use").isNotNull())
    return used.select(c("lang").alias("artifact_id"), pieces).select("artifact_id", "m.field", "m.value").distinct()


def artifacts(members: DataFrame) -> DataFrame:
    """Artifacts with the names of their recorded fields (at most six per artifact)."""
    return members.groupBy("artifact_id").agg(
        F.collect_set("field").alias("fields"),
        F.when(F.col("artifact_id") == "fr", False).alias("provenance_complete"),
    )


MEMBERS = """members AS (
  SELECT DISTINCT lang AS artifact_id, u || f AS field, CASE WHEN f = '_groups' THEN "group" ELSE image_hash END AS value
  FROM (SELECT *, CASE WHEN toxic = 1 THEN 'training' WHEN quality = 0 THEN 'validation'
                       WHEN quality = 1 THEN 'calibration' END AS u FROM samples),
       (VALUES ('_groups'), ('_image_hashes')) AS k(f)
  WHERE u IS NOT NULL),
split_members AS (
  SELECT DISTINCT split, 'group' AS kind, "group" AS value FROM split_samples
  UNION SELECT DISTINCT split, 'image_hash', image_hash FROM split_samples)"""


def chained_artifacts(samples_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One artifact per language and trip, each continuing that of the trip before, five in a chain; and the members of each."""
    named = samples_df.withColumn("lang", F.concat("lang", F.lit("/"), "group"))
    members = artifact_members(named)
    number = F.regexp_extract("artifact_id", "([0-9]+)$", 1).cast("int")
    prior = F.concat(F.regexp_extract("artifact_id", "^(.*?)[0-9]+$", 1), (number - 1).cast("string"))
    found = members.groupBy("artifact_id").agg(F.collect_set("field").alias("fields"), F.lit(None).cast("boolean").alias("provenance_complete"))
    return found.withColumn("prior_id", F.when(number % 5 != 0, prior)), members


CHAINS = """members AS (
  SELECT DISTINCT lang || '/' || "group" AS artifact_id, u || f AS field, CASE WHEN f = '_groups' THEN "group" ELSE image_hash END AS value
  FROM (SELECT *, CASE WHEN toxic = 1 THEN 'training' WHEN quality = 0 THEN 'validation'
                       WHEN quality = 1 THEN 'calibration' END AS u FROM samples),
       (VALUES ('_groups'), ('_image_hashes')) AS k(f)
  WHERE u IS NOT NULL),
artifacts AS (
  SELECT artifact_id, count(DISTINCT field) FILTER (field NOT LIKE 'calibration%') = 4 AS sound,
    CASE WHEN regexp_extract(artifact_id, '([0-9]+)$', 1)::INT % 5 <> 0
         THEN regexp_extract(artifact_id, '^(.*?)[0-9]+$', 1) || (regexp_extract(artifact_id, '([0-9]+)$', 1)::INT - 1) END AS prior_id
  FROM members GROUP BY 1),
chain AS (
  SELECT artifact_id, artifact_id AS ancestor, 0 AS depth, prior_id AS next FROM artifacts
  UNION ALL
  SELECT c.artifact_id, c.next, c.depth + 1, a.prior_id FROM chain c LEFT JOIN artifacts a ON a.artifact_id = c.next WHERE c.next IS NOT NULL)"""


def raw_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS artifact_id",
        "CASE WHEN p_size % 3 = 0 THEN p_size * 16 WHEN p_size % 3 = 1 THEN p_size END AS input_width",
        "CASE WHEN p_size % 4 <> 0 THEN (p_size % 7 + 1) * 16 END AS input_height",
        "CASE WHEN p_size % 5 <> 0 THEN p_size * 8 END AS image_size",
        "CASE WHEN p_partkey % 6 = 0 THEN 0 WHEN p_partkey % 17 = 5 THEN 2 END AS preprocess_version",
        "CASE WHEN p_partkey % 8 = 1 THEN p_size / 40D END AS roi_top",
        "CASE WHEN p_partkey % 3 = 0 THEN 'fast_scnn_lite' WHEN p_partkey % 11 = 1 THEN p_brand END AS architecture",
        "CASE WHEN p_partkey % 13 = 2 THEN 'labels' WHEN p_partkey % 2 = 0 THEN 'probabilities' END AS output_kind",
        "CAST(NULL AS array<string>) AS class_names",
    )


RAW_ARTIFACTS = """raw_artifacts AS (
  SELECT p_partkey AS artifact_id,
         CASE WHEN p_size % 3 = 0 THEN p_size * 16 WHEN p_size % 3 = 1 THEN p_size END AS input_width,
         CASE WHEN p_size % 4 <> 0 THEN (p_size % 7 + 1) * 16 END AS input_height,
         CASE WHEN p_size % 5 <> 0 THEN p_size * 8 END AS image_size,
         CASE WHEN p_partkey % 6 = 0 THEN 0 WHEN p_partkey % 17 = 5 THEN 2 END AS preprocess_version,
         CASE WHEN p_partkey % 8 = 1 THEN p_size / 40.0::DOUBLE END AS roi_top,
         CASE WHEN p_partkey % 3 = 0 THEN 'fast_scnn_lite' WHEN p_partkey % 11 = 1 THEN p_brand END AS architecture,
         CASE WHEN p_partkey % 13 = 2 THEN 'labels' WHEN p_partkey % 2 = 0 THEN 'probabilities' END AS output_kind
  FROM part)"""


# ---------------------------------------------------------------- masks


def mask_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("trip"), F.col("s_suppkey") % 20).alias("group"),
        F.col("s_suppkey").alias("frame_idx"),
        F.lit(MASK_H).alias("height"),
        F.lit(MASK_W).alias("width"),
    )


def raw_runs(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Overlapping spans from order lines: ``truth`` or ``pred`` masks of each supplier's frame."""
    lines = table(spark, sf_dir, "lineitem")
    chosen = {
        "truth": "l_returnflag = 'A' AND l_suppkey % 10 <> 0",
        "pred": "(l_returnflag = 'A' AND l_linenumber <= 5) OR (l_returnflag = 'R' AND l_linenumber = 1)",
        "second": "l_returnflag = 'A' AND l_linenumber <= 6",
    }[which]
    return lines.filter(chosen).selectExpr(
        "concat('trip', l_suppkey % 20) AS group",
        "l_suppkey AS frame_idx",
        f"CAST(l_orderkey % {MASK_H} AS int) AS y",
        f"CAST(l_partkey % {MASK_W} AS int) AS x0",
        f"CAST(least({MASK_W}, l_partkey % {MASK_W} + 1 + CAST(l_quantity AS int) % 12) AS int) AS x1",
    )


MASKS = f"""dims AS (
  SELECT 'trip' || (s_suppkey % 20) AS "group", s_suppkey AS frame_idx, {MASK_H} AS height, {MASK_W} AS width FROM supplier),
spans AS (
  SELECT 'trip' || (l_suppkey % 20) AS "group", l_suppkey AS frame_idx, (l_orderkey % {MASK_H})::INT AS y,
         (l_partkey % {MASK_W})::INT AS x0, least({MASK_W}, l_partkey % {MASK_W} + 1 + CAST(l_quantity AS INT) % 12)::INT AS x1,
         l_returnflag AS flag, l_linenumber AS line, l_suppkey AS k FROM lineitem),
truth AS (SELECT "group", frame_idx, y, x0, x1 FROM spans WHERE flag = 'A' AND k % 10 <> 0),
pred AS (SELECT "group", frame_idx, y, x0, x1 FROM spans WHERE (flag = 'A' AND line <= 5) OR (flag = 'R' AND line = 1)),
pred2 AS (SELECT "group", frame_idx, y, x0, x1 FROM spans WHERE flag = 'A' AND line <= 6)"""


def px(name: str, runs: str) -> str:
    """SQL: the pixel set of a span table."""
    return f'{name} AS (SELECT DISTINCT "group", frame_idx, y, unnest(range(x0, x1)) AS x FROM {runs})'


def px_runs(name: str, pixels: str, extra: str = "") -> str:
    """SQL: maximal spans of a pixel set."""
    keys = f'"group", frame_idx, {extra}y'
    return (
        f"{name} AS (SELECT {keys[:-1]}y::INT AS y, CAST(min(x) AS INT) AS x0, CAST(max(x) + 1 AS INT) AS x1 FROM ("
        f"SELECT *, x - row_number() OVER (PARTITION BY {keys} ORDER BY x) AS isl FROM {pixels}) GROUP BY {keys}, isl)"
    )


def roads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Road shapes parametrised by supplier: a trunk that forks above a row, some cut by the frame side.

    Frames are placed before they become a few hundred spans each, so a partition is bounded by its frames, not by its bytes.
    """
    suppliers = table(spark, sf_dir, "supplier")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), suppliers.count() // ROAD_FRAMES + 1)
    base = suppliers.select(
        F.concat(F.lit("trip"), F.col("s_nationkey")).alias("group"),
        F.col("s_suppkey").alias("frame_idx"),
        F.expr("s_suppkey % 5").alias("kind"),
        F.expr("40 + s_suppkey % 60").alias("split_y"),
        F.expr("70 + s_suppkey * 7 % 120").alias("cx"),
        F.expr("18 + s_suppkey % 9").alias("half"),
    ).repartition(parts, "group", "frame_idx")
    dims = base.select("group", "frame_idx", F.lit(ROAD_H).alias("height"), F.lit(ROAD_W).alias("width"))
    rows = base.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ROAD_H - 1))))
    forked = "kind <> 0 AND y < split_y"
    away = "half + 10 + (split_y - y) div 2"
    arms = rows.withColumn(
        "c", F.expr(f"explode(CASE WHEN {forked} THEN array(cx - ({away}), cx + ({away})) ELSE array(cx) END)")
    )
    spans = arms.selectExpr(
        "group",
        "frame_idx",
        "y",
        "CAST(greatest(0, c - half) AS int) AS x0",
        f"CAST(least({ROAD_W}, c + half) AS int) AS x1",
    )
    return spans.filter("x1 > x0"), dims


ROADS = f"""shapes AS (
  SELECT 'trip' || s_nationkey AS "group", s_suppkey AS frame_idx, s_suppkey % 5 AS kind, 40 + s_suppkey % 60 AS split_y,
         70 + s_suppkey * 7 % 120 AS cx, 18 + s_suppkey % 9 AS half FROM supplier),
road_rows AS (SELECT *, unnest(range(0, {ROAD_H}))::INT AS y FROM shapes),
arms AS (
  SELECT *, cx AS c FROM road_rows WHERE NOT (kind <> 0 AND y < split_y)
  UNION ALL SELECT *, cx - (half + 10 + (split_y - y) // 2) FROM road_rows WHERE kind <> 0 AND y < split_y
  UNION ALL SELECT *, cx + (half + 10 + (split_y - y) // 2) FROM road_rows WHERE kind <> 0 AND y < split_y),
roads AS (
  SELECT * FROM (SELECT "group", frame_idx, y, greatest(0, c - half)::INT AS x0, least({ROAD_W}, c + half)::INT AS x1 FROM arms)
  WHERE x1 > x0)"""


# ---------------------------------------------------------------- arrays


def prob_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding is an 8 x 8 probability map of one frame; its label is the trip."""
    side = F.lit(MAP_SIDE)
    p = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double") * 2 + 0.5)))
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("trip"), F.col("label")).alias("group"),
        F.col("vec_id").alias("frame_idx"),
        side.alias("height"),
        side.alias("width"),
        p.alias("p"),
    )


PROB_MAPS = """map_px AS (
  SELECT 'trip' || label AS "group", vec_id AS frame_idx, (i - 1) // 8 AS y, (i - 1) % 8 AS x,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, embedding[i]::DOUBLE * 2 + 0.5::DOUBLE)) AS p
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def backend_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("trip"), F.col("label")).alias("group"),
        F.col("vec_id").alias("frame_idx"),
        F.transform("embedding", lambda v: v.cast("double")).alias("expected"),
        F.transform("embedding", lambda v: F.floor(v.cast("double") * 8192 + 0.5) / 8192).alias("actual"),
    )


PAIRS = """pair_px AS (
  SELECT 'trip' || label AS "group", vec_id AS frame_idx, i, embedding[i]::DOUBLE AS e,
         floor(embedding[i]::DOUBLE * 8192 + 0.5::DOUBLE) / 8192 AS a
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


# ---------------------------------------------------------------- detections

FIRST_DAY = "2024-01-01"


def _detected(events: DataFrame) -> DataFrame:
    """Source, frame, order and measures of each event as a detection."""
    return events.select(
        "user_id",
        micros(events).alias("us"),
        "event_id",
        F.concat(F.lit("trip"), F.col("user_id")).alias("group"),
        F.datediff("ts", F.lit(FIRST_DAY)).cast("long").alias("frame_idx"),
        (F.col("event_id") * 37 % DET_W).cast("double").alias("end_x"),
        (F.col("event_id") * 11 % DET_H).cast("double").alias("end_y"),
        (5 + F.col("value") % 20).alias("width_px"),
    )


def _shape(end_x: Column, end_y: Column, width_px: Column, det_idx: Column) -> list[Column]:
    """Columns of a detection."""
    dx, dy = end_x - 128, end_y - 80
    length = F.sqrt(dx * dx + dy * dy)
    unit = lambda v, zero: F.when(length == 0, F.lit(zero)).otherwise(v / length)
    return [
        det_idx.cast("int").alias("det_idx"),
        F.lit(128.0).alias("split_x"),
        F.lit(80.0).alias("split_y"),
        F.lit(128.0).alias("start_x"),
        F.lit(114.0).alias("start_y"),
        end_x.alias("end_x"),
        end_y.alias("end_y"),
        unit(dx, 0.0).alias("dir_x"),
        unit(dy, -1.0).alias("dir_y"),
        length.alias("length"),
        width_px.alias("width_px"),
        (length * width_px).alias("area"),
    ]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user and day are the branch detections of one frame; days count on from the first one."""
    ranked = _positions(_detected(table(spark, sf_dir, "events")), ["group", "frame_idx"], "_pos")
    c = F.col
    return ranked.select(
        "group", "frame_idx", F.lit(DET_H).alias("height"), F.lit(DET_W).alias("width"), *_shape(c("end_x"), c("end_y"), c("width_px"), c("_pos"))
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day up to the last one is a frame of every user, with or without detections; days before ``FIRST_DAY`` count if they have events."""
    events = table(spark, sf_dir, "events")
    day = F.datediff("ts", F.lit(FIRST_DAY))
    first, last = (d or 0 for d in events.agg(F.min(day), F.max(day)).first())
    days = F.explode(F.sequence(F.lit(min(first, 0)).cast("long"), F.lit(last).cast("long")))
    frames = (
        events.select(F.concat(F.lit("trip"), F.col("user_id")).alias("group"))
        .distinct()
        .select(
            "group",
            days.alias("frame_idx"),
            F.lit(DET_H).alias("height"),
            F.lit(DET_W).alias("width"),
            F.lit(False).alias("reset"),
        )
    )
    # A frame's detections are one array anyway, so they are numbered in it.
    listed = _detected(events).groupBy("group", "frame_idx").agg(
        F.sort_array(F.collect_list(F.struct("us", "event_id", "end_x", "end_y", "width_px"))).alias("dets")
    )
    shaped = F.transform("dets", lambda e, i: F.struct(*_shape(e["end_x"], e["end_y"], e["width_px"], i)))
    return fill_blank(frames, listed.withColumn("dets", shaped))


DETECTIONS = f"""detections AS (
  SELECT *, length * width_px AS area FROM (
  SELECT "group", frame_idx, {DET_H} AS height, {DET_W} AS width, det_idx, end_x, end_y, width_px,
         sqrt((end_x - 128) * (end_x - 128) + (end_y - 80) * (end_y - 80)) AS length
  FROM (SELECT 'trip' || user_id AS "group", date_diff('day', DATE '{FIRST_DAY}', ts) AS frame_idx, event_id,
               row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) - 1 AS det_idx,
               (event_id * 37 % {DET_W})::DOUBLE AS end_x, (event_id * 11 % {DET_H})::DOUBLE AS end_y,
               5 + value % 20 AS width_px FROM events)))"""


def sql(*views: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(views) + "\n" + body.strip()
