"""Benchmark decontamination with DataFrame functions alone.

A window is ``WINDOW`` consecutive words of a benchmark item, or all words of a shorter item. The windows' hashes are a set of
checked size that is broadcast; document windows are looked up in it and each hit is verified on the words themselves.

Most documents hold no window, so a first look spares them the full scan: whichever of its positions a window of L words
starts at, it covers a whole aligned block of (L + 1) // 2 words. Only documents with an aligned block that some
window contains are scanned word by word. The first look drops no hit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import stored

WINDOW = 10
#: Fixed value: what separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A set with more rows than this is not broadcast; the lookup is then an ordinary join.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _windows(items: DataFrame, size: int) -> DataFrame:
    """Rows ``item_id, gram, size, h``: windows of the items with exactly that window size."""
    n = F.size("words")
    mine = items.filter(n >= size if size == WINDOW else n == size)
    gram = F.explode(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.slice("words", i, size)))
    return mine.select("item_id", gram.alias("gram")).select("item_id", "gram", F.lit(size).alias("size"), F.xxhash64("gram").alias("h"))


def _lookup(rows: DataFrame, table: DataFrame, n: int, on: list[str], how: str) -> DataFrame:
    return rows.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, on, how)


def _grams(size: int, step: int, column: str = "words") -> Column:
    """Hashes of the word runs of a size, every ``step`` words."""
    count = F.floor((F.size(column) - size) / F.lit(step)).cast("int")
    starts = F.when(F.size(column) >= size, F.sequence(F.lit(0), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(column, i * step + 1, size)))


def scan(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document as ``doc_id, text_key, n_words`` and the verified hits ``doc_id, text_key, pos, size, item_id``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    sizes = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())
    windows = None
    for size in sizes:
        own = _windows(items, size)
        windows = own if windows is None else windows.union(own)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    if windows is None:
        rows = keyed.select("doc_id", "text_key", F.size("words").cast("bigint").alias("n_words"))
        return rows, rows.select("doc_id", "text_key", F.lit(0).alias("pos"), F.lit(0).alias("size"), F.lit("").alias("item_id")).filter("false")
    windows = stored(windows.distinct(), "windows")
    blocks = sorted({(size + 1) // 2 for size in sizes})
    parts = [windows.filter(F.floor((F.col("size") + 1) / 2) == b).select(F.explode(_grams(b, 1, "gram")).alias("h")) for b in blocks]
    first = parts[0]
    for part in parts[1:]:
        first = first.union(part)
    first = stored(first.distinct(), "blocks")
    looked = stored(
        keyed.select("doc_id", "text_key", F.size("words").cast("bigint").alias("n_words"), F.concat(*[_grams(b, b) for b in blocks]).alias("grams")),
        "aligned",
    )
    exploded = looked.select("doc_id", "text_key", F.explode("grams").alias("h"))
    suspects = stored(_lookup(exploded, first, first.count(), ["h"], "left_semi").select("doc_id", "text_key").distinct(), "suspects")
    d, s = keyed.alias("d"), suspects.alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key"))
    near = d.join(s, same, "left_semi")
    placed = None
    for size in sizes:
        runs = near.select("doc_id", "text_key", "words", F.posexplode(_grams(size, 1)).alias("pos", "h"))
        runs = runs.select("doc_id", "text_key", "pos", "h", F.lit(size).alias("size"), F.slice("words", F.col("pos") + 1, size).alias("found"))
        placed = runs if placed is None else placed.union(runs)
    hits = _lookup(placed, windows, windows.count(), ["h", "size"], "inner").filter(F.col("found") == F.col("gram"))
    return looked.drop("grams"), stored(hits.select("doc_id", "text_key", "pos", "size", "item_id").distinct(), "hits")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document.

    Null and empty texts have no words and no hits. Items without words have no window. A repeated row has its result repeated;
    rows of one ``doc_id`` with different texts are told apart. No items: nothing is hit.
    """
    rows, hits = scan(docs, benchmark)
    key = ["doc_id", "text_key"]
    covered = hits.select(*key, F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("word")).distinct()
    n_hit = covered.groupBy(*key).agg(F.count("*").alias("n_hit"))
    found = hits.groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    for table in (n_hit, found):
        r, t = rows.alias("r"), table.alias("t")
        same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.text_key") == F.col("t.text_key"))
        rows = r.join(t, same, "left").select("r.*", *[f"t.{c}" for c in table.columns if c not in key])
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """The documents without contamination, all their columns kept.

    ``remove="documents"`` drops every document with a hit; ``remove="spans"`` cuts the hit words, each with the separators up
    to the next word, out of the text instead. Other documents are returned unchanged.
    """
    _, hits = scan(docs, benchmark)
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    d = docs.withColumn("__text_key", F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("h.doc_id")) & (F.col("d.__text_key") == F.col("h.text_key"))
    if remove == "documents":
        return d.join(hits.select("doc_id", "text_key").distinct().alias("h"), same, "left_anti").select(*columns)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    gone = hits.select("doc_id", "text_key", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("word"))
    gone = gone.groupBy("doc_id", "text_key").agg(F.collect_set("word").alias("gone")).alias("h")
    inside = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    outside = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    joined = d.join(gone, same, "left").withColumn("__pieces", F.when(F.col("h.gone").isNotNull(), F.regexp_extract_all("d.text", F.lit(f"({inside}+{outside}*)"), 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__pieces") - 1), F.col("h.gone"))
    lead = F.regexp_extract("d.text", f"^{outside}*", 0)
    kept = F.concat(lead, F.array_join(F.transform(left, lambda i: F.element_at("__pieces", i + 1)), ""))
    text = F.when(F.col("h.gone").isNull(), F.col("d.text")).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
