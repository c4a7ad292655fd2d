"""Queries over samples: pairing, audit, splits, provenance, artifacts, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanespan.functions import exprs
from lanespan.operators import audit, fingerprint, provenance, splitting, training
from lanespan.plans import views as v
from lanespan.plans.registry import query
from lanespan.session import shared_folder
from lanespan.sources.files import extract_every_n, extraction_ledger, scan_manifest
from lanespan.sources.sinks import write_manifest

SPLIT = (v.SAMPLES, v.ASSIGNED)


def split_samples(spark, sf):
    base = v.samples(spark, sf)
    return splitting.apply_split(base, splitting.assign_groups(base))


@query(
    "group_split",
    v.sql(*SPLIT, body='SELECT "group", split, count(*) AS samples FROM split_samples GROUP BY 1, 2'),
)
def group_split(spark, sf):
    return split_samples(spark, sf).groupBy("group", "split").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "split_audit",
    v.sql(
        *SPLIT,
        body="""
SELECT split, samples, "groups", negative_frames, image_hashes,
       CASE WHEN samples = 0 THEN 'empty split' WHEN negative_frames = 0 THEN 'no negative frames' END AS fault
FROM (SELECT s.split, count(x.split) AS samples, count(DISTINCT x."group") AS "groups",
             count(*) FILTER (x.negative) AS negative_frames, count(DISTINCT image_hash) AS image_hashes
      FROM (VALUES ('train'), ('validation'), ('test')) AS s(split) LEFT JOIN split_samples x USING (split) GROUP BY 1)""",
    ),
)
def split_audit(spark, sf):
    return audit.split_audit(split_samples(spark, sf))


@query("split_members", v.sql(*SPLIT, v.MEMBERS, body="SELECT * FROM split_members"))
def split_members(spark, sf):
    return audit.split_members(split_samples(spark, sf))


# The manifest under audit gives every document the split of its language, so groups and
# copies cross splits and the leakage checks have something to find.
BY_LANG = """by_lang AS (
  SELECT *, CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'validation' ELSE 'test' END AS split FROM samples)"""


def by_language(spark, sf):
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "validation").otherwise("test")
    return v.samples(spark, sf).withColumn("split", split)


def _leak_sql(key: str) -> str:
    return v.sql(
        v.SAMPLES,
        BY_LANG,
        body=f"""SELECT {key}, min(split) AS first_split, max(split) AS last_split, count(*) AS samples
FROM by_lang GROUP BY 1 HAVING count(DISTINCT split) > 1""",
    )


@query("group_leakage", _leak_sql('"group"'))
def group_leakage(spark, sf):
    return audit.group_leakage(by_language(spark, sf))


CONTENT = v.sql(
    *SPLIT,
    body="""SELECT image_hash, min(split) AS first_split, max(split) AS last_split, count(*) AS samples
FROM split_samples GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)


@query("content_leakage", CONTENT)
def content_leakage(spark, sf):
    return audit.content_leakage(split_samples(spark, sf))


@query(
    "path_reuse",
    v.sql(
        v.FILES,
        body="""SELECT path, count(*) AS uses FROM (
  SELECT i.path FROM files i WHERE kind = 'image' UNION ALL SELECT path FROM files WHERE kind = 'mask')
GROUP BY 1 HAVING count(*) > 1""",
    ),
)
def path_reuse(spark, sf):
    is_image = F.col("kind") == "image"
    pairs = v.files(spark, sf).select(
        F.when(is_image, F.col("path")).alias("image"), F.when(~is_image, F.col("path")).alias("mask")
    )
    return audit.path_reuse(pairs).filter("path IS NOT NULL")


RECORD = """'["' || split || '", "' || "group" || '", "' || image_hash || '", "' || mask_hash || '"]'"""


# Copies of a document lie in several groups; a clean manifest has each content once.
@query(
    "manifest_roundtrip",
    v.sql(
        *SPLIT,
        body="""SELECT split, "group", image, mask FROM split_samples
QUALIFY row_number() OVER (PARTITION BY image_hash ORDER BY split, "group", image) = 1""",
    ),
)
def manifest_roundtrip(spark, sf):
    samples = split_samples(spark, sf)
    order = ["split", "group", "image"]
    rest = [c for c in samples.columns if c not in (*order, "image_hash")]
    once = samples.groupBy("image_hash").agg(F.min(F.struct(*order, *rest)).alias("_s")).select("image_hash", "_s.*")
    out = shared_folder(spark, "manifest")
    write_manifest(once, out, require_negatives=False)
    return scan_manifest(spark, out).drop("pos")


@query(
    "dataset_digest",
    v.sql(
        *SPLIT,
        body=f"""
SELECT CAST(sum(n) AS BIGINT) AS records, sha256(string_agg(b || ':' || h, ',' ORDER BY b || ':' || h)) AS dataset_digest
FROM (SELECT substr(r, 1, 4) AS b, sha256(string_agg(r || ':' || n, ',' ORDER BY r || ':' || n)) AS h, sum(n) AS n
      FROM (SELECT sha256({RECORD}) AS r, count(*) AS n FROM split_samples GROUP BY 1) GROUP BY 1)""",
    ),
)
def dataset_digest(spark, sf):
    return audit.dataset_digest(split_samples(spark, sf))


RECORD_FIELDS = ["split", "group", "image_hash", "mask_hash"]


@query(
    "dataset_merkle",
    v.sql(
        *SPLIT,
        f"""leaves AS (SELECT substr(r, 1, 2) AS prefix, sha256(string_agg(r || ':' || n, ',' ORDER BY r || ':' || n)) AS digest, sum(n) AS records
  FROM (SELECT sha256({RECORD}) AS r, count(*) AS n FROM split_samples GROUP BY 1) GROUP BY 1)""",
        """middle AS (SELECT substr(prefix, 1, 1) AS prefix, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix || ':' || digest)) AS digest,
    sum(records) AS records FROM leaves GROUP BY 1)""",
        body="""
SELECT 2 AS level, prefix, digest, records::BIGINT AS records FROM leaves UNION ALL SELECT 1, prefix, digest, records::BIGINT FROM middle
UNION ALL SELECT 0, '', sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix || ':' || digest)), sum(records)::BIGINT FROM middle""",
    ),
)
def dataset_merkle(spark, sf):
    return fingerprint.merkle_tree(fingerprint.record_digests(split_samples(spark, sf), RECORD_FIELDS), 2)


OTHER_SPLIT = (
    v.ASSIGNED.replace("assigned AS", "other_assigned AS")
    .replace("JOIN assigned", "JOIN other_assigned")
    .replace("split_samples AS", "other_samples AS")
    .replace("'42|'", "'43|'")
)


@query(
    "dataset_diff",
    v.sql(
        *SPLIT,
        OTHER_SPLIT,
        body=f"""
SELECT record, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n
FROM (SELECT {RECORD} AS record, count(*) AS n FROM split_samples GROUP BY 1) a
FULL JOIN (SELECT {RECORD} AS record, count(*) AS n FROM other_samples GROUP BY 1) b USING (record)
WHERE a.n IS DISTINCT FROM b.n""",
    ),
)
def dataset_diff(spark, sf):
    """Records that change when the groups are split by another seed."""
    base = v.samples(spark, sf)
    splits = [splitting.apply_split(base, splitting.assign_groups(base, seed)) for seed in (42, 43)]
    return fingerprint.difference(*[fingerprint.record_digests(s, RECORD_FIELDS) for s in splits])


@query(
    "split_intersection",
    v.sql(
        v.SAMPLES,
        BY_LANG,
        body="""
SELECT DISTINCT 'group' AS kind, "group" AS value FROM by_lang a WHERE split = 'train'
  AND EXISTS (SELECT 1 FROM by_lang b WHERE b.split = 'test' AND b."group" = a."group")
UNION ALL
SELECT DISTINCT 'image_hash', image_hash FROM by_lang a WHERE split = 'train'
  AND EXISTS (SELECT 1 FROM by_lang b WHERE b.split = 'test' AND b.image_hash = a.image_hash)""",
    ),
)
def split_intersection(spark, sf):
    return audit.split_intersection(audit.split_members(by_language(spark, sf)), "train", "test")


@query(
    "calibration_sample",
    v.sql(
        *SPLIT,
        """placed AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY sha256('42|' || image), image) - 1 AS round
  FROM split_samples WHERE split = 'train')""",
        """firsts AS (SELECT *, row_number() OVER (PARTITION BY image_hash
    ORDER BY round, sha256('42|' || "group"), "group", image) AS rn FROM placed)""",
        body="""SELECT "group", image, image_hash, round FROM firsts WHERE rn = 1
ORDER BY round, sha256('42|' || "group"), "group", image LIMIT 200""",
    ),
)
def calibration_sample(spark, sf):
    # The smallest tables hold fewer contents than a calibration needs.
    return splitting.round_robin_sample(split_samples(spark, sf), 200, 42, allow_short=True)


# ---------------------------------------------------------------- pairing


@query(
    "pair_images",
    v.sql(
        v.FILES,
        body="""SELECT *, CASE WHEN masks > 1 THEN 'ambiguous mask' WHEN images > 1 THEN 'duplicate image'
  WHEN masks = 0 THEN 'missing mask' WHEN images = 0 THEN 'orphan mask' END AS fault FROM pairs""",
    ),
)
def pair_images(spark, sf):
    return audit.pair_images_masks(v.files(spark, sf))


@query("orphan_masks", v.sql(v.FILES, body='SELECT "group", stem, mask FROM pairs WHERE images = 0'))
def orphan_masks(spark, sf):
    return audit.orphan_masks(v.files(spark, sf))


@query("missing_masks", v.sql(v.FILES, body='SELECT "group", stem, image FROM pairs WHERE masks = 0'))
def missing_masks(spark, sf):
    return audit.missing_masks(v.files(spark, sf))


@query(
    "mask_stem",
    v.sql(v.FILES, body="SELECT path, stem FROM stems WHERE kind = 'mask'"),
)
def mask_stem(spark, sf):
    return v.files(spark, sf).filter("kind = 'mask'").select("path", exprs.mask_stem("path").alias("stem"))


@query(
    "valid_group",
    """SELECT page_id, kind, coalesce(regexp_full_match(name, '[\\w.-]+') AND name NOT IN ('.', '..'), false) AS extractable,
  coalesce(length(trim(name)) > 0, false) AS listable
FROM (SELECT page_id, unnest(['url', 'host', 'last', 'dots', 'blank']) AS kind,
             unnest([url, host, regexp_extract(url, '([^/]*)$', 1), regexp_replace(host, '[^.]', '', 'g'), regexp_replace(host, '.', ' ', 'g')]) AS name
      FROM (SELECT page_id, url, regexp_extract(url, '//([^/]*)', 1) AS host FROM pages))""",
)
def valid_group(spark, sf):
    """Names out of every page's own address: whole, its host, its last piece, the host's dots alone, and blanks of its length."""
    host = F.regexp_extract("url", "//([^/]*)", 1)
    names = {
        "url": F.col("url"),
        "host": host,
        "last": F.regexp_extract("url", "([^/]*)$", 1),
        "dots": F.regexp_replace(host, "[^.]", ""),
        "blank": F.regexp_replace(host, ".", " "),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("name")) for k, n in names.items()])).alias("p")
    return v.table(spark, sf, "pages").select("page_id", each).select(
        "page_id",
        "p.kind",
        exprs.valid_extraction_group("p.name").alias("extractable"),
        exprs.valid_manifest_group("p.name").alias("listable"),
    )


PAIR_FACTS = """facts AS (
  SELECT image, mask, quality IS NOT NULL AS mask_exists, doc_id % 23 <> 0 AS readable,
         CASE WHEN doc_id % 19 = 0 THEN 3 ELSE 1 END AS channels, n_chars AS height, 80 AS width,
         CASE WHEN doc_id % 17 = 0 THEN n_chars + 1 ELSE n_chars END AS mask_height, 80 AS mask_width, doc_id
  FROM (SELECT d.doc_id, d.n_chars, l.quality, 'img/' || d.doc_id AS image, 'mask/' || d.doc_id AS mask
        FROM documents d LEFT JOIN labels l USING (doc_id)))"""


@query(
    "pair_faults",
    v.sql(
        PAIR_FACTS,
        body="""SELECT image, mask, CASE WHEN NOT mask_exists THEN 'missing file' WHEN NOT readable THEN 'unreadable'
  WHEN channels <> 1 THEN 'not single-channel' WHEN height <> mask_height THEN 'size mismatch' ELSE 'non-binary' END AS fault
FROM facts WHERE NOT mask_exists OR NOT readable OR channels <> 1 OR height <> mask_height OR doc_id % 4 IN (2, 3)""",
    ),
)
def pair_faults(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = v.table(spark, sf, "labels").select("doc_id", "quality")
    values = "CASE doc_id % 4 WHEN 0 THEN array(0, 255) WHEN 1 THEN array(1, 0, 1) WHEN 2 THEN array(0, 127) ELSE array(0, 1, 255) END"
    facts = docs.join(labels, "doc_id", "left").selectExpr(
        "concat('img/', doc_id) AS image",
        "concat('mask/', doc_id) AS mask",
        "quality IS NOT NULL AS mask_exists",
        "doc_id % 23 <> 0 AS readable",
        "CASE WHEN doc_id % 19 = 0 THEN 3 ELSE 1 END AS channels",
        "n_chars AS height",
        "80 AS width",
        "CASE WHEN doc_id % 17 = 0 THEN n_chars + 1 ELSE n_chars END AS mask_height",
        "80 AS mask_width",
        f"{values} AS mask_values",
    )
    return audit.pair_faults(facts)


@query(
    "content_digest",
    """SELECT doc_id, sha256('(' || n_chars || ', 1, 3)' || text) AS image_hash,
  sha256('(' || n_chars || ', 1)' || text) AS mask_hash FROM documents""",
)
def content_digest(spark, sf):
    pixels = F.encode("text", "utf-8")
    return v.table(spark, sf, "documents").select(
        "doc_id",
        exprs.content_digest(pixels, "n_chars", F.lit(1), F.lit(3)).alias("image_hash"),
        exprs.content_digest(pixels, "n_chars", F.lit(1)).alias("mask_hash"),
    )


# ---------------------------------------------------------------- provenance and artifacts


def _members(spark, sf):
    return v.artifact_members(v.samples(spark, sf))


@query(
    "provenance_overlap",
    v.sql(
        *SPLIT,
        v.MEMBERS,
        body="""
SELECT DISTINCT m.artifact_id, CASE WHEN field LIKE '%_groups' THEN 'group' ELSE 'image_hash' END AS kind, m.value
FROM members m JOIN split_members s ON s.split = 'test' AND s.value = m.value
 AND s.kind = CASE WHEN field LIKE '%_groups' THEN 'group' ELSE 'image_hash' END""",
    ),
)
def provenance_overlap(spark, sf):
    current = audit.split_members(split_samples(spark, sf))
    return provenance.provenance_overlap(_members(spark, sf), current, "test")


@query(
    "provenance_status",
    v.sql(
        *SPLIT,
        v.MEMBERS,
        """overlap AS (SELECT artifact_id, count(DISTINCT m.value) AS overlap_count
  FROM members m JOIN split_members s ON s.split = 'validation' AND s.value = m.value AND field LIKE 'training%' GROUP BY 1)""",
        """status AS (SELECT artifact_id, coalesce(overlap_count, 0) AS overlap_count,
   (count(DISTINCT field) FILTER (field NOT LIKE 'calibration%')) = 4 AND artifact_id <> 'fr' AS verified
  FROM members LEFT JOIN overlap USING (artifact_id) GROUP BY 1, 2)""",
        body="""SELECT *, CASE WHEN overlap_count > 0 THEN 'leakage' WHEN NOT verified THEN 'incomplete provenance' END AS verdict
FROM status""",
    ),
)
def provenance_status(spark, sf):
    members = _members(spark, sf)
    current = audit.split_members(split_samples(spark, sf))
    return provenance.provenance_status(v.artifacts(members), members, current, "validation")


@query(
    "merge_provenance",
    v.sql(
        *SPLIT,
        v.MEMBERS,
        body="""
SELECT artifact_id, field, value FROM members WHERE field NOT LIKE 'calibration%'
UNION
SELECT lang, CASE split WHEN 'train' THEN 'training' ELSE 'validation' END ||
  CASE kind WHEN 'group' THEN '_groups' ELSE '_image_hashes' END, CASE kind WHEN 'group' THEN "group" ELSE image_hash END
FROM split_samples, (VALUES ('group'), ('image_hash')) AS k(kind) WHERE split <> 'test' AND lang IN (SELECT artifact_id FROM members)""",
    ),
)
def merge_provenance(spark, sf):
    """Every artifact goes on training with the current splits of its language."""
    current = audit.split_members(split_samples(spark, sf).withColumnRenamed("lang", "artifact_id"), "artifact_id")
    return provenance.merge_members(_members(spark, sf), current)


@query(
    "provenance_chains",
    v.sql(
        v.SAMPLES,
        v.CHAINS,
        body="""SELECT DISTINCT c.artifact_id, field, value FROM chain c JOIN members m ON m.artifact_id = c.ancestor
WHERE field NOT LIKE 'calibration%'""",
        recursive=True,
    ),
)
def provenance_chains(spark, sf):
    return provenance.merge_chains(*v.chained_artifacts(v.samples(spark, sf)))[0]


@query(
    "chain_status",
    v.sql(
        v.SAMPLES,
        v.CHAINS,
        body="""SELECT c.artifact_id, max(depth) AS depth, coalesce(bool_and(coalesce(a.sound, false)) FILTER (depth > 0), true) AS complete
FROM chain c LEFT JOIN artifacts a ON a.artifact_id = c.ancestor GROUP BY 1""",
        recursive=True,
    ),
)
def chain_status(spark, sf):
    return provenance.merge_chains(*v.chained_artifacts(v.samples(spark, sf)))[1]


@query(
    "artifact_normalize",
    v.sql(
        v.RAW_ARTIFACTS,
        """filled AS (
  SELECT artifact_id, input_width IS NULL <> (input_height IS NULL) AS half,
    coalesce(preprocess_version, CASE WHEN input_width IS NOT NULL OR input_height IS NOT NULL THEN 1 ELSE 0 END) AS preprocess_version,
    CASE WHEN input_width IS NULL AND input_height IS NULL THEN image_size ELSE input_width END AS input_width,
    CASE WHEN input_width IS NULL AND input_height IS NULL THEN image_size ELSE input_height END AS input_height,
    roi_top, coalesce(architecture, 'lite_road_net') AS architecture, coalesce(output_kind, 'logits') AS output_kind
  FROM raw_artifacts)""",
        """done AS (SELECT * REPLACE (coalesce(roi_top, CASE preprocess_version WHEN 1 THEN 0.2 ELSE 0.0 END) AS roi_top) FROM filled)""",
        body="""
SELECT artifact_id, architecture, input_width, input_height, roi_top, preprocess_version, output_kind, CASE
  WHEN half THEN 'both input sizes required'
  WHEN preprocess_version NOT IN (0, 1) THEN 'unsupported version'
  WHEN input_width IS NULL THEN 'no input size'
  WHEN input_width < 16 OR input_height < 16 THEN 'input too small'
  WHEN preprocess_version = 1 AND (input_width % 16 <> 0 OR input_height % 16 <> 0) THEN 'not a multiple of 16'
  WHEN roi_top < 0 OR roi_top >= 1 THEN 'roi_top out of range'
  WHEN preprocess_version = 0 AND (roi_top <> 0 OR input_width <> input_height) THEN 'legacy input must be square and uncropped'
  WHEN architecture NOT IN ('lite_road_net', 'fast_scnn_lite') THEN 'unknown architecture'
  WHEN output_kind NOT IN ('logits', 'probabilities') THEN 'unknown output kind' END AS error
FROM done""",
    ),
)
def artifact_normalize(spark, sf):
    return provenance.normalize_artifacts(v.raw_artifacts(spark, sf)).drop("class_names")


# ---------------------------------------------------------------- history and extraction

HISTORY = """history AS (
  SELECT c_nationkey AS run_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS epoch,
         round((c_acctbal + 1000) / 11000, 3) AS iou FROM customer)"""


def history(spark, sf):
    """Customers of a nation play the epochs of a training run."""
    from lanespan.functions.ordered import block_of, with_position

    customers = v.table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    placed = with_position(customers, ["c_nationkey"], ["c_custkey"], block_of("c_custkey"))
    return placed.select(
        F.col("c_nationkey").alias("run_id"),
        (F.col("pos") + 1).alias("epoch"),
        F.round((F.col("c_acctbal") + 1000) / 11000, 3).alias("iou"),
    )


@query(
    "history_resume",
    v.sql(
        HISTORY,
        body="""SELECT run_id, epoch, iou FROM history WHERE epoch <= 12
UNION ALL SELECT run_id, 12 + epoch, iou FROM history WHERE epoch <= 3""",
    ),
)
def history_resume(spark, sf):
    past = history(spark, sf)
    new = past.filter("epoch <= 3").withColumn("epoch", F.col("epoch") + 12)
    return training.append_history(past, new, 12)


@query(
    "running_best",
    v.sql(
        HISTORY,
        body="""SELECT run_id, epoch, iou, iou > coalesce(max(iou) OVER (PARTITION BY run_id ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e308) AS improved FROM history""",
    ),
)
def running_best(spark, sf):
    return training.running_best(history(spark, sf)).drop("best_before")


@query(
    "best_epoch",
    v.sql(
        HISTORY,
        body="""SELECT run_id, arg_max(epoch, (iou, -epoch)) AS best_epoch, max(iou) AS best_score, count(*) AS epochs
FROM history GROUP BY 1""",
    ),
)
def best_epoch(spark, sf):
    return training.best_epoch(history(spark, sf))


@query(
    "every_n_frames",
    v.sql(
        v.FRAMES_SEQ,
        body="""SELECT "group", frame_idx, "group" || '_frame_' || lpad(frame_idx::VARCHAR, 6, '0') AS name
FROM frames_seq WHERE frame_idx % 10 = 0""",
    ),
)
def every_n_frames(spark, sf):
    return extract_every_n(v.frames_seq(spark, sf), 10).select("group", "frame_idx", "name")


@query(
    "extraction_ledger",
    v.sql(
        v.FRAMES_SEQ,
        body="""SELECT "group", 10 AS every, count(*) AS frames_decoded,
  count(*) FILTER (frame_idx % 10 = 0) AS frames_saved FROM frames_seq GROUP BY 1""",
    ),
)
def ledger(spark, sf):
    return extraction_ledger(v.frames_seq(spark, sf), 10)


@query(
    "letterbox_plan",
    """WITH s AS (SELECT doc_id, 1 + n_chars % 1900 AS h, 1 + doc_id * 37 % 3000 AS w FROM documents),
r AS (SELECT *, least(h - 1, CAST(trunc(h * 0.2::DOUBLE) AS INT)) AS roi_y FROM s),
k AS (SELECT *, least(256.0::DOUBLE / w, 144.0::DOUBLE / (h - roi_y)) AS scale FROM r),
c AS (SELECT *, greatest(1, least(256, CAST(round_even(w * scale, 0) AS INT))) AS cw,
        greatest(1, least(144, CAST(round_even((h - roi_y) * scale, 0) AS INT))) AS ch FROM k)
SELECT doc_id, h::INT AS original_height, w::INT AS original_width, roi_y::INT AS roi_y, 256 AS input_width, 144 AS input_height,
  (256 - cw) // 2 AS "left", (144 - ch) // 2 AS top, cw AS content_width, ch AS content_height FROM c""",
)
def letterbox_plan(spark, sf):
    sized = v.table(spark, sf, "documents").selectExpr("doc_id", "1 + n_chars % 1900 AS h", "1 + doc_id * 37 % 3000 AS w")
    return sized.select("doc_id", exprs.letterbox_plan("h", "w", 256, 144).alias("plan")).select("doc_id", "plan.*")
