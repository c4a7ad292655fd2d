"""Interaction of five document filters: what each would remove at each step of each of their 120 orders.

Every document fails some of the filters; which ones is its mask. Only the counts of documents by part and mask matter, and there
are at most 32 masks. Each such cell is folded along the array of all orders: one struct for each order and step, weighted
by the cell's counts. The arrays of a part's cells are then summed element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import skew_join, stored

#: Limits of the filters A, B and C, and the characters that D looks for.
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
MARKS = "[#$%&*|]"
BLANK = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of every row; bit k of the mask is set where the document fails the k-th of the filters A to E.

    A: too few words. B: too few of the words distinct. C: too many capitals. D: a character of ``MARKS``. E: the same text has a row with a
    smaller ``doc_id``; a null ``doc_id`` counts as larger than any other, and rows that share an id are no copies of each other. Null
    text counts as empty: it fails A only (and E as a copy of another empty text). Null ``lang`` is part ``''``.
    """
    text = _text()
    words = F.array_remove(F.split(text, BLANK), "")
    n_words, n_chars = F.size("words"), F.length("text")
    upper = n_chars - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = {
        "A": n_words < MIN_WORDS,
        "B": F.size(F.array_distinct("words")) * 100 < n_words * DISTINCT_PERCENT,
        "C": upper.cast("bigint") * 100 > n_chars.cast("bigint") * UPPER_PERCENT,
        "D": F.col("text").rlike(MARKS),
    }
    plain = F.lit(0)
    for name, failed in fails.items():
        plain = plain.bitwiseOR(F.when(failed, _bit(F.lit(name))).otherwise(0))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        words.alias("words"),
    ).select("doc_id", "part", plain.alias("plain"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = stored(rows, "filter-facts")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    joined = skew_join(rows, stored(copies, "copied-texts"), "digest", "copies", rows.count(), "left")
    later = F.coalesce((F.col("doc_id") > F.col("first")) | (F.col("doc_id").isNull() & F.col("first").isNotNull()), F.lit(False))
    return joined.select("doc_id", "part", F.col("plain").bitwiseOR(F.when(later, _bit(F.lit("E"))).otherwise(0)).alias("mask"))


def _bit(letter: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)]), letter)


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents with a mask, and those of them labelled good or toxic.

    An id that has several labels is good (toxic) when any of them says so; a null id has none. Rows are counted by id before they meet the labels, so
    an id that very many rows share is one row by then.
    """
    by_id = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marks = [F.coalesce(F.max(F.col(c).cast("int") == 1), F.lit(False)).alias(n) for c, n in (("quality", "is_good"), ("toxic", "is_toxic"))]
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*marks)
    joined = by_id.join(known, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def _fold(orders: Column) -> Column:
    """Structs of a cell's share in every order and step, by a fold along each order that carries the filters applied so far."""
    mask, n = F.col("mask"), F.col("n")
    item = "filter_order string, step int, filter string, " + ", ".join(f"{c} bigint" for c in COUNTS)
    none = F.array().cast(f"array<struct<{item.replace(' ', ':').replace(',:', ',')}>>")

    def weigh(condition: Column, weight: Column) -> Column:
        return F.when(condition, weight).otherwise(F.lit(0).cast("bigint"))

    def one(order: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            letter = F.substr(order, k, F.lit(1))
            bit, before = _bit(letter), state["before"]
            fails = mask.bitwiseAND(bit) != 0
            first = fails & (mask.bitwiseAND(before) == 0)
            after = before.bitwiseOR(bit)
            row = F.struct(
                order.alias("filter_order"),
                k.alias("step"),
                letter.alias("filter"),
                weigh(mask.bitwiseAND(after) == 0, n).alias("kept"),
                weigh(first, n).alias("removed"),
                weigh(fails & ~first, n).alias("redundant"),
                weigh(mask == bit, n).alias("unique_fails"),
                weigh(first, F.col("good")).alias("good_lost"),
                weigh(first, F.col("toxic")).alias("toxic_lost"),
            )
            return F.struct(after.alias("before"), F.concat(state["rows"], F.array(row)).alias("rows"))

        start = F.struct(F.lit(0).alias("before"), none.alias("rows"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), start, step, lambda state: state["rows"])

    return F.flatten(F.transform(orders, one))


def _added(left: Column, right: Column) -> Column:
    same = [left[c].alias(c) for c in ("filter_order", "step", "filter")]
    return F.struct(*same, *[(left[c] + right[c]).alias(c) for c in COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Counts are of documents of the part: kept after the step, removed in it, failing its filter but removed before, failing its filter
    alone, and the removed ones that are labelled good or toxic. ``shapley`` is the number that the step's filter removes, summed over
    all orders. The 120 orders are one literal array that travels with the plan. A part has at most 32 cells, so the list of
    its arrays is bounded whatever the input. An empty table has no parts and gives no rows; repeated rows count as documents each.
    """
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    folded = cells(failures(docs), labels).select("part", _fold(orders).alias("steps"))
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("all"))
    total = F.aggregate(
        F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda sums, own: F.zip_with(sums, own, _added)
    )
    letters = F.array(*[F.lit(f) for f in FILTERS])

    def removed_by(letter: Column) -> Column:
        own = F.filter("steps", lambda s: s["filter"] == letter)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda sums, s: sums + s["removed"])

    whole = merged.select("part", F.explode_outer(F.array(total)).alias("steps"))
    shared = whole.select("part", "steps", F.map_from_arrays(letters, F.transform(letters, removed_by)).alias("shares"))
    rows = shared.select("part", "shares", F.explode("steps").alias("s"))
    return rows.select("part", "s.filter_order", "s.step", *[f"s.{c}" for c in COUNTS], F.element_at("shares", F.col("s.filter")).alias("shapley"))
