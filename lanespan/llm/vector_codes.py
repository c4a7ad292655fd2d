"""Compression of vectors to short codes: each part of a vector becomes the index of the nearest entry of that part's codebook.

Codebooks are fitted by Lloyd rounds over all vectors, in whole numbers, so results do not depend on order or partitions. Each
part carries its entry and its exact distance from round to round. If that entry did not move in the last update, no entry
that stayed can have become nearer, so only the entries that moved are compared; a part whose entry moved looks at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import skew_join, stored

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
#: Whole components are held within this; squared distances of up to 128 components then fit in a long.
REACH = 1 << 27
#: Exactness limit of float64, and the differences held at a time where distances need whole numbers.
EXACT, HELD = 1 << 53, 1 << 20
STATE = "vec_id bigint, vector array<int>, codes array<int>, distances array<bigint>"


def whole_vectors(table: DataFrame, column: str = "embedding", parts: int = PARTS) -> DataFrame:
    """``vec_id, label, vector``: components as ``floor(1024 * x)``, without rows whose vector is null or has a null or non-finite component.

    Vectors are filled with zeros to the length of the longest one, and that to a multiple of ``parts``. Components beyond ``REACH``
    count as ``REACH``.
    """
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    kept = table.filter(F.col(column).isNotNull() & ~bad)
    longest = kept.agg(F.max(F.size(column))).first()[0] or 0
    length = -(-longest // parts) * parts
    filled = F.concat(F.col(column).cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(length) - F.size(column)))

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x * SCALE, F.lit(float(REACH))), F.lit(float(-REACH)))).cast("int")

    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.transform(filled, whole).alias("vector"))


def distances(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each entry."""
    reach = max(int(np.abs(part).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * part.shape[1] * reach * reach < EXACT:
        x, e = part.astype(np.float64), entries.astype(np.float64)
        # Sums and products of whole numbers below the limit are exact in any order.
        return ((x * x).sum(1)[:, None] - 2 * (x @ e.T) + (e * e).sum(1)).astype(np.int64)
    out = np.empty((len(part), len(entries)), np.int64)
    step = max(1, HELD // max(1, entries.size))
    for lo in range(0, len(part), step):
        out[lo : lo + step] = ((part[lo : lo + step, None].astype(np.int64) - entries[None]) ** 2).sum(2)
    return out


def _nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, the lower index among equals, and its distance."""
    found = distances(part, entries)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(part)), best]


def assign(part: np.ndarray, entries: np.ndarray, held: np.ndarray, kept: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries after an update, from the entries and distances held before it and the flags of entries that moved."""
    codes, found = held.copy(), kept.copy()
    calm = ~moved[held]
    active = np.flatnonzero(moved)
    if len(active) and calm.any():
        at = np.flatnonzero(calm)
        rival, distance = _nearest(part[at], entries[active])
        rival = active[rival]
        wins = (distance < kept[at]) | ((distance == kept[at]) & (rival < held[at]))
        codes[at[wins]], found[at[wins]] = rival[wins], distance[wins]
    again = np.flatnonzero(~calm)
    if len(again):
        codes[again], found[again] = _nearest(part[again], entries)
    return codes, found


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _assigned(state: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The state after assigning every part to ``books`` (part, entry, position); ``moved`` is None before the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"), np.int64)
            own = np.split(vectors, len(books), axis=1)
            if moved is None:
                pairs = [_nearest(part, book) for part, book in zip(own, books, strict=True)]
            else:
                held, kept = _matrix(batch.column("codes"), np.int64), _matrix(batch.column("distances"), np.int64)
                pairs = [assign(own[p], books[p], held[:, p], kept[:, p], moved[p]) for p in range(len(books))]
            codes, found = (np.stack(x, axis=1) for x in zip(*pairs, strict=True))
            columns = [batch.column("vec_id"), batch.column("vector"), _lists(codes, pa.int32()), _lists(found, pa.int64())]
            out = pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "codes", "distances"])
            yield out.append_column("label_key", batch.column("label_key"))

    return state.mapInArrow(run, f"{STATE}, label_key string")


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the parts of each entry, and their number; tasks add up first, so a task sends one row per entry and position at most."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, codes = _matrix(batch.column("vector"), np.int64), _matrix(batch.column("codes"), np.int64)
            for p, part in enumerate(np.split(vectors, parts, axis=1)):
                order = np.argsort(codes[:, p], kind="stable")
                used, first, n = np.unique(codes[order, p], return_index=True, return_counts=True)
                sums[p, used] += np.add.reduceat(part[order], first)
                counts[p, used] += n
        p, entry = np.nonzero(counts)
        cell = np.repeat((p * entries + entry) * width, width) + np.tile(np.arange(width), len(p))
        columns = [pa.array(cell), pa.array(sums[p, entry].ravel()), pa.array(np.repeat(counts[p, entry], width))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "total", "n"])

    partial = state.select("vector", "codes").mapInArrow(run, "cell bigint, total bigint, n bigint")
    sums, counts = np.zeros(parts * entries * width, np.int64), np.zeros(parts * entries * width, np.int64)
    for row in partial.groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        sums[row.cell], counts[row.cell] = row.total, row.n
    return sums.reshape(shape), counts.reshape(shape)


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """Codes of ``vec_id, label_key, vector`` rows, and the codebooks as (part, entry, position).

    Codebooks begin as the parts of the rows with the smallest ``vec_id`` (null last; equal ones by their vectors). In every
    round each part goes to its nearest entry, the lower index among equals, and each entry becomes the floor of its parts' mean;
    an entry without parts stays. With fewer rows than entries the codebooks are as small as the table. The driver holds the codebooks
    and nothing that grows with the table. An empty table has empty codebooks and no codes.
    """
    state = vectors
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first or not first[0].vector:
        books = np.zeros((parts, len(first), 0), np.int64)
        zeros = [F.array_repeat(F.lit(0).cast(kind), parts) for kind in ("int", "bigint")]
        return state.select("vec_id", "vector", zeros[0].alias("codes"), zeros[1].alias("distances"), "label_key"), books
    books = np.stack(np.split(np.array([r.vector for r in first], np.int64), parts, axis=1))
    moved = None
    for _ in range(rounds):
        state = stored(_assigned(state, books, moved), "vector-state")
        sums, counts = _sums(state, books.shape)
        after = np.where(counts > 0, sums // np.maximum(counts, 1), books)
        moved = (after != books).any(axis=2)
        books = after
    return stored(_assigned(state, books, moved), "vector-state"), books


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Whole-number vectors that rows of codes stand for."""
    return np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], axis=1)


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in print, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(table: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row that has a usable vector.

    ``label_error`` is the error summed over the rows with the same label; rows without a label belong together. Repeated rows give
    repeated results and all count. An empty table, or one without usable vectors, gives no rows.
    """
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = stored(whole_vectors(table, column).select("vec_id", "vector", label.alias("label_key")), "vectors")
    coded, books = compress(rows)
    hexed = F.transform("codes", lambda k: F.lower(F.lpad(F.hex(k.cast("bigint")), 2, "0")))
    errors = coded.select(
        "vec_id", F.array_join(hexed, "").alias("code"), F.aggregate("distances", F.lit(0).cast("bigint"), lambda s, d: s + d).alias("error"), "label_key"
    )
    totals = errors.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("copies"))
    joined = skew_join(errors, stored(totals, "label-errors"), "label_key", "copies", errors.count())
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
