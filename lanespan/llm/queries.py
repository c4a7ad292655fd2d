"""Queries of this subpackage on the given tables, each over the whole table, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanespan.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    filter_audit,
    language,
    packing,
    quality,
    sequences,
    sharding,
    simhash,
    suffixes,
    toxicity,
    vector_codes,
)
from lanespan.llm.common import documents
from lanespan.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), benchmark_items(spark, sf_dir))


OP2_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
doc_words AS (
  SELECT doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
wins AS (
  SELECT DISTINCT item_id, len(w[i:i + least(len(w), 10) - 1]) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item_words WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, pos, size, array_to_string(w[pos + 1:pos + size], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(generate_series(0, len(w) - size)) AS pos
        FROM doc_words, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)),
hits AS (SELECT DISTINCT doc_id, pos, size, item_id FROM runs JOIN wins USING (size, gram)),
covered AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS word FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(len(coalesce(items, [])) AS BIGINT) AS n_items,
       sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op3_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.encode_and_read(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir)).drop("kept")


OP5_SQL = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, n, b, substr(h, 2 * b + 1, 498) AS piece FROM (SELECT doc_id, n, h, unnest(range(0, n, 200)) AS b FROM d)),
w AS (
  SELECT doc_id, b + o AS p, substr(piece, 2 * o + 1, 100) AS s
  FROM (SELECT doc_id, b, piece, unnest(range(0, greatest(least(200, n - 49 - b), 0))) AS o FROM pieces)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE doc_id > first),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS opens FROM hit),
island AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM island GROUP BY 1, 2),
parts AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY 1),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN e IS NULL THEN substr(h, 2 * s + 1) ELSE substr(h, 2 * s + 1, 2 * (e - s)) END, '' ORDER BY s) AS k
  FROM parts JOIN d USING (doc_id) GROUP BY 1),
totals AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir)).drop("spans")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "digest-index"))
    rows = index.add(documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_ROWS = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest([0, 1, 2, 3]) AS p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= 256)"""
OP11_ASSIGN = """,
near{k} AS MATERIALIZED (
  SELECT rid, p, any_value(x) AS x,
         min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + e) AS best
  FROM parts JOIN book{k} USING (p) GROUP BY 1, 2)"""
OP11_UPDATE = """,
mean{k} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT p, best % 256 AS e, i, sum(y)::BIGINT AS s, count(*) AS n
        FROM (SELECT p, best, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{k}) GROUP BY 1, 2, 3)
  GROUP BY 1, 2),
book{next} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""
OP11_RESULT = """,
coded AS (
  SELECT rid, string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM near4 GROUP BY 1),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), book
"""
OP11_SQL = (
    OP11_ROWS
    + "".join(OP11_ASSIGN.format(k=k) + OP11_UPDATE.format(k=k, next=k + 1) for k in range(4))
    + OP11_ASSIGN.format(k=4)
    + OP11_RESULT
)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), ids=False)
    return packed.withColumn("length", F.col("length").cast("bigint"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
facts AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > first OR (doc_id IS NULL AND first IS NOT NULL), false) AS e
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM d)),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
cells AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM facts LEFT JOIN known USING (doc_id) GROUP BY 1, 2),
letter AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
  SELECT [p.f, q.f, r.f, s.f, t.f] AS o FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
steps AS (SELECT o, k, o[k] AS f, o[1:k - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
shares AS (
  SELECT *, fails[f] AS own, len(list_filter(before, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM steps, cells),
sums AS (
  SELECT part, o, k, f, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (own AND alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM shares GROUP BY 1, 2, 3, 4)
SELECT part, array_to_string(list_transform(o, lambda x: chr((64 + x)::INT)), '') AS filter_order, k::INT AS step, kept, removed, redundant,
       unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM sums
"""


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_sequences": op3_sequences,
    "op4_simhash": op4_simhash,
    "op5_suffixes": op5_suffixes,
    "op6_language": op6_language,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_packing": op12_packing,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op5_suffixes": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op11_vector_codes": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
