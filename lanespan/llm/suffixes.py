"""Repeated passages by suffix sorting with bucket-pointer refinement.

A byte goes when a ``WINDOW``-byte string over it also starts in a document with a smaller id. Equal windows have to meet to be found,
but only where there can be any:

1. Every window has an anchor, the least q-gram in it by a fixed order of hashes. Neighbouring windows mostly share it; such a run of
   windows is one entry, with hashes of the q-gram and of the run's bytes. Equal windows have equal q-grams as anchors.
2. Entries meet by q-gram. Where one document has it, nothing is repeated. Runs that are equal as a whole are settled: all but
   the first document's go. Where a q-gram has different runs, some of their windows may be equal.
3. Only those runs are fetched from the texts, once for each different run, and their suffixes are sorted: buckets of equal q-grams are
   refined by the buckets of the positions q further on, 2q further on and so forth, each round on the ids that the one
   before it left, until a bucket is one window's bytes. Positions alone in their bucket are done and leave.

A q-gram that many documents have comes last in the order. Windows at the borders of a passage that is everywhere then have anchors
outside it, so no anchor gathers more than few documents' runs, and runs inside the passage are equal and reduced to one per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import stored, text_bytes
from lanespan.llm.pretokens import _powers

WINDOW, GRAM = 50, 16
#: Bytes looked at together: positions and hashes share a 64-bit number.
SLICE = 1 << 20
#: Entries a map task holds before it sends them, entries of a group, bytes of runs in a group.
HELD, GROUP, RUNS = 1 << 20, 1 << 21, 2 << 20
#: Sample for the order of q-grams (documents, their largest size, share of them that makes a q-gram frequent). It only balances work.
SAMPLE, LARGEST, FREQUENT = 1000, 1 << 16, 0.01
PLACES = 1 << 20
LAST = (1 << 63) - 1
REQUEST = np.dtype([("p", "<i4"), ("n", "<i4"), ("g", "<u8")])


def _byte_numbers() -> np.ndarray:
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xAEF17502108EF2D9)
    return x ^ (x >> np.uint64(29))


BYTES = _byte_numbers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(20, len(data).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=total[1:])
    return total, down


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at each position."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, down = _sums(data)
    return _mixed((total[GRAM : GRAM + n] - total[:n]) * down[:n])


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes put together from texts, and of each piece its text, its begin there and its begin in the text.

    Pieces of a long text overlap by a window less one byte, so each window lies in one piece.
    """
    parts, owner, shift, size = [], [], [], 0

    def ready():
        begin = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), begin, np.array(owner), np.array(shift, np.int64)

    for k, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - WINDOW + 1), SLICE // 2):
            part = text[lo : lo + SLICE // 2 + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            if size + len(part) > SLICE:
                yield ready()
                parts, owner, shift, size = [], [], [], 0
            parts.append(part)
            owner.append(k)
            shift.append(lo)
            size += len(part)
    if parts:
        yield ready()


def entries(data: np.ndarray, begin: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: their piece, begin in the data, number of windows, hash of the q-gram and of the bytes."""
    total, down = _sums(data)
    n = len(data) - GRAM + 1
    g = _mixed((total[GRAM : GRAM + n] - total[:n]) * down[:n])
    late = frequent[(g & np.uint64(PLACES - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
    low = np.uint64(SLICE - 1)
    least = ((g >> np.uint64(1) | late) & ~low) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= WINDOW - GRAM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WINDOW - GRAM + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & low).astype(np.int64)
    valid = np.ones(len(data), bool)
    ends = begin[1:]
    for back in range(1, WINDOW):
        valid[ends - back] = False
    at = np.flatnonzero(valid[: len(anchor)])
    a = anchor[at]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
    count = np.diff(np.r_[first, len(at)])
    p = at[first]
    bytes_ = _mixed((total[p + count + WINDOW - 1] - total[p]) * down[p] + count.astype(np.uint64))
    return np.searchsorted(begin, p, "right") - 1, p, count, g[a[first]], bytes_


def _cut48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _full48(raw: list[bytes]) -> np.ndarray:
    short = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
    return np.pad(short, ((0, 0), (0, 2))).view("<u8").ravel()


ENTRIES = "part int, key bigint, payload binary, g binary, s binary, who binary, at binary, n binary"
SENT = pa.schema(
    [("part", pa.int32()), ("key", pa.int64()), *[(c, pa.binary()) for c in ("payload", "g", "s", "who", "at", "n")]]
)


def _by_key(keys: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Records of each key, as bytes."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, records = keys[order], records[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        yield int(keys[a]), records[a:b].tobytes()


def _spans(p: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.stack([p, length], axis=1).astype("<i4")


def _send(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        key, who, p, n, g, s = (np.concatenate(c) for c in zip(*held, strict=True))
        # Equal runs of this batch: the smallest document's stays, the others' are settled.
        order = np.lexsort((who, s, g))
        same = np.r_[False, (g[order][1:] == g[order][:-1]) & (s[order][1:] == s[order][:-1])]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        gone = np.zeros(len(order), bool)
        gone[order] = who[order] > who[order][head]
        rows: dict[str, list] = {c: [] for c in SENT.names}

        def add(**values) -> None:
            for c in rows:
                rows[c].append(values.get(c))

        for k, raw in _by_key(key[gone], _spans(p[gone], n[gone] + WINDOW - 1)):
            add(part=k % parts, key=k, payload=raw)
        stay = ~gone
        key, who, p, n, g, s = key[stay], who[stay], p[stay], n[stay], g[stay], s[stay]
        part = ((g >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            i = order[cut[k] : cut[k + 1]]
            owners = np.stack([key[i], who[i]], axis=1).astype("<i8").tobytes()
            add(part=k, g=_cut48(g[i]), s=_cut48(s[i]), who=owners, at=p[i].astype("<u4").tobytes(), n=n[i].astype(np.uint8).tobytes())
        held.clear()
        return pa.RecordBatch.from_pydict(rows, schema=SENT)

    waiting = 0
    for batch in batches:
        keys, ids = batch.column("key").to_numpy(), batch.column("who").to_numpy()
        for data, begin, owner, shift in pieces([t.as_py() for t in batch.column("text")]):
            piece, p, n, g, s = entries(data, begin, frequent)
            held.append((keys[owner[piece]], ids[owner[piece]], p - begin[piece] + shift[piece], n, g, s))
            waiting += len(p)
            if waiting >= HELD:
                yield flush()
                waiting = 0
    if held:
        yield flush()


DECISIONS = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
SETTLED, ASKED = 0, 1


def _meet(table: pa.Table) -> pa.Table:
    """Settle the runs of a group of q-grams; ask for the bytes of those that may be equal in part."""
    out: list[tuple[int, int, bytes]] = []
    settled = table.filter(pa.compute.is_valid(table.column("payload")))
    out += [(k, SETTLED, raw) for k, raw in zip(settled.column("key").to_pylist(), settled.column("payload").to_pylist(), strict=True)]
    sent = table.filter(pa.compute.is_valid(table.column("g")))
    if len(sent):
        raw = {c: sent.column(c).to_pylist() for c in ("g", "s", "who", "at", "n")}
        g, s = _full48(raw["g"]), _full48(raw["s"])
        owner = np.frombuffer(b"".join(raw["who"]), "<i8").reshape(-1, 2)
        p, n = np.frombuffer(b"".join(raw["at"]), "<u4").astype(np.int64), np.frombuffer(b"".join(raw["n"]), np.uint8).astype(np.int64)
        key, who = owner[:, 0], owner[:, 1]
        order = np.lexsort((who, s, g))
        g, s, key, who, p, n = g[order], s[order], key[order], who[order], p[order], n[order]
        new_gram = np.r_[True, g[1:] != g[:-1]]
        new_run = new_gram | np.r_[True, s[1:] != s[:-1]]
        gram, first = np.cumsum(new_gram) - 1, np.flatnonzero(new_gram)
        shared = (np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first))[gram]
        several = (np.add.reduceat(new_run.astype(np.int64), first) > 1)[gram]
        least = who[np.maximum.accumulate(np.where(new_run, np.arange(len(g)), 0))]
        gone = shared & (who > least)
        out += [(k, SETTLED, raw) for k, raw in _by_key(key[gone], _spans(p[gone], n[gone] + WINDOW - 1))]
        asked = shared & several & (who == least)
        requests = np.zeros(int(asked.sum()), REQUEST)
        requests["p"], requests["n"], requests["g"] = p[asked], n[asked], g[asked]
        out += [(k, ASKED, raw) for k, raw in _by_key(key[asked], requests)]
    keys, kinds, payloads = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], schema=DECISIONS)


RUN_ROWS = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("who", "at", "n", "bytes")]])


def _fetch(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the runs asked for, grouped by q-gram."""
    for batch in batches:
        who, at, count, gram, run = [], [], [], [], []
        for key, ident, text, asked in zip(*(batch.column(c) for c in ("key", "who", "text", "asked")), strict=True):
            requests = np.frombuffer(b"".join(asked.as_py()), REQUEST)
            raw = text.as_py()
            who.append(np.tile(np.array([[key.as_py(), ident.as_py()]], "<i8"), (len(requests), 1)))
            at.append(requests["p"])
            count.append(requests["n"])
            gram.append(requests["g"])
            run += [raw[p : p + n + WINDOW - 1] for p, n in zip(requests["p"].tolist(), requests["n"].tolist(), strict=True)]
        if not run:
            continue
        part = (np.concatenate(gram) % np.uint64(parts)).astype(np.int64)
        who, at, count = np.concatenate(who), np.concatenate(at), np.concatenate(count)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        rows: dict[str, list] = {c: [] for c in RUN_ROWS.names}
        for k in np.flatnonzero(np.diff(cut)).tolist():
            i = order[cut[k] : cut[k + 1]]
            values = (k, who[i].tobytes(), at[i].tobytes(), count[i].tobytes(), b"".join([run[j] for j in i.tolist()]))
            for c, v in zip(rows, values, strict=True):
                rows[c].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=RUN_ROWS)


def refine(text: np.ndarray, begin: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Bucket of the ``window`` bytes at each position of some runs; -1 where no other position has the same bytes.

    ``begin`` has where each run begins, and the end. Buckets start as those of eight bytes. A bucket of size q and the bucket of the
    position q further on make one of size 2q; the last round looks at the distance that is missing. A position leaves once it
    is alone, or its later one is, as no equal string can follow.
    """
    n = len(text)
    room = np.repeat(begin[1:], np.diff(begin)) - np.arange(n)
    bucket = np.full(n, -1, np.int64)
    start = np.flatnonzero(room >= 8)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    first = np.lib.stride_tricks.sliding_window_view(padded, 8)[start]
    value = np.ascontiguousarray(first).view(">u8").ravel().astype(np.uint64)
    size = 8

    def sort_into_buckets(at: np.ndarray, keys: tuple[np.ndarray, ...]) -> None:
        order = np.lexsort(keys[::-1])
        change = np.zeros(len(at), bool)
        change[:1] = True
        for k in keys:
            change[1:] |= k[order][1:] != k[order][:-1]
        number = np.cumsum(change) - 1
        alone = np.bincount(number, minlength=1) == 1
        bucket[at] = -1
        bucket[at[order]] = np.where(alone[number], -1, number)

    if len(start):
        sort_into_buckets(start, (value,))
    while size < window:
        step = min(size, window - size)
        at = np.flatnonzero((bucket >= 0) & (room >= size + step))
        later = bucket[at + step]
        own = bucket[at]
        bucket_kept = later >= 0
        lost = np.flatnonzero(bucket >= 0)
        new_at, keys = at[bucket_kept], (own[bucket_kept], later[bucket_kept])
        bucket[lost] = -1
        if not len(new_at):
            break
        sort_into_buckets(new_at, keys)
        size += step
    return bucket


REMOVED = pa.schema([("key", pa.int64()), ("payload", pa.binary())])


def _sort_runs(table: pa.Table) -> pa.Table:
    """Windows of a group of runs that start in an earlier document too, as spans."""
    raw = {c: table.column(c).to_pylist() for c in ("who", "at", "n", "bytes")}
    owner = np.frombuffer(b"".join(raw["who"]), "<i8").reshape(-1, 2)
    p, n = (np.frombuffer(b"".join(raw[c]), "<i4").astype(np.int64) for c in ("at", "n"))
    text = np.frombuffer(b"".join(raw["bytes"]), np.uint8)
    begin = np.r_[0, np.cumsum(n + WINDOW - 1)]
    bucket = refine(text, begin)
    at = np.flatnonzero(bucket >= 0)
    run = np.searchsorted(begin, at, "right") - 1
    who = owner[run, 1]
    least = np.full(int(bucket.max(initial=-1)) + 1, LAST, np.int64)
    np.minimum.at(least, bucket[at], who)
    gone = who > least[bucket[at]]
    at, run = at[gone], run[gone]
    first = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(at)])
    run, place = run[first], p[run[first]] + at[first] - begin[run[first]]
    rows = list(_by_key(owner[run, 0], _spans(place, count + WINDOW - 1)))
    keys, payloads = zip(*rows, strict=True) if rows else ((), ())
    return pa.table([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], schema=REMOVED)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        rows: list[tuple] = []
        for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
            raw = text.as_py()
            spans = gone.as_py()
            if not spans:
                rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                continue
            p, length = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2).T.astype(np.int64)
            edges = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edges, p, 1)
            np.add.at(edges, p + length, -1)
            removed = np.cumsum(edges[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~removed].tobytes()
            runs = int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum())
            rows.append((len(raw), int(removed.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Which places of a table of q-gram hashes hold one that many documents of a small sample have."""
    small = docs.select("key", "text").filter(F.octet_length("text") <= LARGEST)
    chosen = small.select("key").distinct().orderBy("key").limit(SAMPLE)
    texts = [bytes(r.text) for r in small.join(F.broadcast(chosen), "key").dropDuplicates(["text"]).select("text").collect()]
    places = np.zeros(PLACES, bool)
    if texts:
        found, counts = np.unique(np.concatenate([np.unique(grams(np.frombuffer(t, np.uint8))) for t in texts]), return_counts=True)
        often = found[counts >= max(3, FREQUENT * len(texts))]
        places[(often & np.uint64(PLACES - 1)).astype(np.int64)] = True
    return places


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row; ``kept`` has the bytes that are left.

    Texts are UTF-8 bytes; null counts as empty. Matches lie inside one document and are judged on the input. Rows that
    share a ``doc_id`` are not earlier than each other, so neither loses a byte to the other; a null id is later than all others. Texts
    shorter than a window lose nothing. An empty table gives an empty table.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("who"),
        text_bytes().alias("text"),
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    frequent = frequent_grams(rows)
    parts = int(size // (GROUP * 16) + 16)
    sent = rows.select("key", "who", "text").mapInArrow(lambda batches: _send(batches, frequent, parts), ENTRIES)
    decisions = stored(sent.groupBy("part").applyInArrow(_meet, "key bigint, kind int, payload binary"), "decisions")
    fetched = decisions.filter(F.col("kind") == ASKED).agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0]
    groups = int(fetched // REQUEST.itemsize * (WINDOW + GRAM) // RUNS + 16)
    asked = decisions.filter(F.col("kind") == ASKED).groupBy("key").agg(F.collect_list("payload").alias("asked"))
    runs = rows.join(asked, "key").select("key", "who", "text", "asked").mapInArrow(
        lambda batches: _fetch(batches, groups), "part int, who binary, at binary, n binary, bytes binary"
    )
    sorted_runs = runs.groupBy("part").applyInArrow(_sort_runs, "key bigint, payload binary")
    gone = decisions.filter(F.col("kind") == SETTLED).select("key", "payload").union(sorted_runs)
    gone = stored(gone.groupBy("key").agg(F.collect_list("payload").alias("gone")), "gone")
    return rows.join(gone, "key", "left").select("doc_id", "text", "gone").mapInArrow(_cut, RESULT)
