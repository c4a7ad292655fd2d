"""SimHash near-dedup over a Gray-order hierarchical index.

A fingerprint is 64 bits from the XXH64 hashes of word shingles. Fingerprints at a Hamming distance within the limit are
linked; linked documents form components.

Index. Two fingerprints within distance 2 agree on one of three blocks of bits and, among the bits outside that block, on
one of three sub-blocks. Each fingerprint is therefore sent to nine keys (block and sub-block values), and every pair to be
linked meets under at least one. The entries under a key share those bits: they are the root of a tree. Below it the entries lie in
the order of their Gray rank, so neighbours differ in few bits; every run of ``FAN`` entries is a node, runs of nodes are upper
nodes. A node keeps the bits that all entries below share, less those its parent has. A search adds up the differences on
the way down and leaves a node, with all below it, once they exceed the limit or once all below is already linked to the
fingerprint looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import skew_join, slices, stored, text_bytes
from lanespan.llm.components import components

SHINGLE = 3
SEED = 42
LIMIT = 2
FAN = 16
#: Fingerprints searched at a time, and nodes they may visit on a level; bounds the memory of a search.
SEARCHED, VISITED = 4096, 250_000
#: Shingles hashed at a time; bounds the memory for a very long text.
HASHED = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Fingerprint of one text in UTF-8: a bit is set when it is set in over half the shingle hashes; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for lo in range(0, len(starts), HASHED):
        spans = zip(starts[lo : lo + HASHED].tolist(), ends[lo : lo + HASHED].tolist(), strict=True)
        h = np.array([hashed(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, fp`` of every row; ``fp`` has the 64 bits as a signed number, ``text_key`` is a hash of the text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps)], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))
    return rows.mapInArrow(hashed, "doc_id bigint, text_key bigint, fp bigint")


def _keys() -> list[tuple[int, int]]:
    """Masks of the nine keys: a block of three, and a third of the bits outside it."""
    blocks = [range(0, 21), range(21, 42), range(42, 64)]
    masks = []
    for block in blocks:
        rest = [b for b in range(64) if b not in block]
        third = -(-len(rest) // 3)
        for k in range(3):
            bits = [*block, *rest[k * third : (k + 1) * third]]
            masks.append(sum(1 << b for b in bits))
    return masks


KEYS = _keys()


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _distance(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class GrayIndex:
    """Forest over fingerprints; entries with the same group number share a root, whose known bits are ``mask``."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray, masks: np.ndarray):
        order = np.lexsort((gray_rank(codes), groups))
        self.codes, self.groups = codes[order], groups[order]
        masks = masks[order]
        first = np.flatnonzero(np.r_[True, self.groups[1:] != self.groups[:-1]]) if len(codes) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(codes)])
        # Levels from the entries up: start of each node in the level below, the entries' span, bits shared below.
        self.levels: list[dict] = []
        starts, per_group = np.arange(len(codes)), sizes
        shared, pattern = np.full(len(codes), ~np.uint64(0)), self.codes
        span = np.arange(len(codes) + 1)
        while len(per_group) and per_group.max() > 1:
            nodes = -(-per_group // FAN)
            base = np.repeat(np.r_[0, np.cumsum(per_group)[:-1]], nodes)
            within = np.arange(nodes.sum()) - np.repeat(np.r_[0, np.cumsum(nodes)[:-1]], nodes)
            starts = base + within * FAN
            both = np.bitwise_and.reduceat(pattern, starts)
            either = np.bitwise_or.reduceat(pattern, starts)
            shared = np.bitwise_and.reduceat(shared, starts) & ~(both ^ either)
            pattern = both
            span = np.r_[span[starts], len(codes)]
            self.levels.append({"starts": np.r_[starts, span_end(starts, per_group)], "shared": shared, "pattern": pattern, "span": span})
            per_group = nodes
        self.first, self.masks = first, masks

    def links(self, limit: int = LIMIT) -> np.ndarray:
        """For each entry, the position of an entry linked to it directly or through others (its own if it has none)."""
        n = len(self.codes)
        root = np.arange(n)
        if n < 2:
            return root

        def find() -> np.ndarray:
            nonlocal root
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    return root
                root = up

        def unite(a: np.ndarray, b: np.ndarray) -> None:
            while len(a):
                r = find()
                a, b = r[a], r[b]
                apart = a != b
                a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
                np.minimum.at(root, a, b)

        same = self.groups[1:] == self.groups[:-1]
        near = np.flatnonzero(same & (_distance(self.codes[1:] ^ self.codes[:-1]) <= limit))
        unite(near, near + 1)
        if not self.levels:
            return find()
        group_of = np.cumsum(np.r_[True, ~same]) - 1
        sizes = np.diff(np.r_[self.first, n])
        multiple = np.flatnonzero(sizes[group_of] > 1)
        step = max(FAN, min(SEARCHED, VISITED // int(sizes.max() // FAN + 1)))
        for lo in range(0, len(multiple), step):
            asked = multiple[lo : lo + step]
            r = find()
            node = group_of[asked]
            spent = np.zeros(len(asked), np.int16)
            known = self.masks[asked]
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                # All below is linked to the one asked for: nothing to be found there.
                a, z = level["span"][node], level["span"][node + 1]
                low = np.minimum.reduceat(r, level["span"][:-1])[node]
                high = np.maximum.reduceat(r, level["span"][:-1])[node]
                mine = r[asked]
                fresh = level["shared"][node] & ~known
                spent = spent + _distance((self.codes[asked] ^ level["pattern"][node]) & fresh)
                go = (spent <= limit) & ~((low == mine) & (high == mine)) & (z > a)
                asked, node, spent, known = asked[go], node[go], spent[go], (known | fresh)[go]
                begin, end = level["starts"][node], level["starts"][node + 1]
                counts = end - begin
                asked, spent, known = np.repeat(asked, counts), np.repeat(spent, counts), np.repeat(known, counts)
                node = np.repeat(begin - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            rest = spent + _distance((self.codes[asked] ^ self.codes[node]) & ~known)
            hit = (rest <= limit) & (asked != node)
            unite(asked[hit], node[hit])
        return find()


def span_end(starts: np.ndarray, per_group: np.ndarray) -> np.ndarray:
    """End of the last node, as one more start."""
    return np.array([per_group.sum()], starts.dtype)


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``high, low`` between distinct fingerprints ``fp``, enough to connect all within the limit and no others."""
    placed = distinct.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(KEYS)])
        ).alias("at"),
    ).select("fp", F.col("at.way").alias("way"), F.col("at.bits").alias("bits"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array(KEYS, np.uint64)
        held: list[pa.RecordBatch] = []

        def search() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            codes = table.column("fp").to_numpy().view(np.uint64)
            way, bits = table.column("way").to_numpy(), table.column("bits").to_numpy()
            change = np.r_[True, (way[1:] != way[:-1]) | (bits[1:] != bits[:-1])]
            index = GrayIndex(codes, np.cumsum(change), masks[way])
            root = index.links()
            moved = np.flatnonzero(root != np.arange(len(root)))
            a, b = index.codes[moved].view(np.int64), index.codes[root[moved]].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["high", "low"])

        # Keys come in order; what is held is searched at a border between two keys once there is enough.
        for batch in batches:
            if held and sum(map(len, held)) >= 1 << 18:
                way, bits = held[-1].column("way")[-1].as_py(), held[-1].column("bits")[-1].as_py()
                other = (batch.column("way").to_numpy() != way) | (batch.column("bits").to_numpy() != bits)
                if other.any():
                    cut = int(np.argmax(other))
                    held.append(batch.slice(0, cut))
                    yield search()
                    held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield search()

    return placed.repartition("way", "bits").sortWithinPartitions("way", "bits").mapInArrow(linked, "high bigint, low bigint").distinct()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, fp, root, component_id, group_size`` of every row.

    ``root`` is the component's smallest fingerprint and tells components apart; ``component_id`` does not where ids are null or
    shared by unlike texts. ``component_id`` is the smallest ``doc_id`` among all documents reachable over links, itself included. Null text counts as
    empty; texts without words have fingerprint zero and are linked like any other. Fewer words than a shingle: the
    whole sequence is the one shingle. A null ``doc_id`` is never the smallest unless its component has no other.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("group_size"))
    settled = stored(named.join(smallest, "root").select("fp", "root", "component_id", "copies", "group_size"), "components")
    return skew_join(rows, settled, "fp", "copies", rows.count()).drop("copies")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest ``doc_id`` (null last), with its columns."""
    groups = near_groups(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = groups.groupBy("root").agg(F.min(order).alias("first"))
    keep = first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).alias("k")
    mine = docs.withColumn("__text_key", F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("k.doc_id")) & (F.col("d.__text_key") == F.col("k.text_key"))
    return mine.join(keep, same, "left_semi").dropDuplicates(["doc_id", "__text_key"]).select(*[f"`{c}`" for c in docs.columns])
