"""Best-fit packing of documents into sequences of a fixed length, by linear grouping.

A plan needs only how many pieces there are of each length, and lengths are at most 2048, so the plan is made on the driver from a
table of at most 2048 rows, whatever the number of documents, and speaks of "so many sequences of this make-up":

1. Large lengths, in falling order, are cut into groups of equally many pieces; each counts as its group's largest.
2. These few sizes are packed by configurations (how many of each size a sequence takes). A linear programme over them is solved
   with columns made on demand: the best new configuration under the current prices is a knapsack.
3. Actual pieces take the places of their group, which leaves the room that rounding up had taken.
4. What is left over, and then all small pieces, go longest first to where they fit best.

Pieces of a length are alike to the plan. Spark ranks them within their length, and a piece's rank says its place.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Tokenizer

from lanespan.llm.common import stored, text_bytes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY, END = 2048, 0
#: Lengths over this share of a sequence are large; they are rounded up to so many sizes.
LARGE_SHARE, GROUPS = 8, 48
#: Bounds of the room that substitution may leave in a sequence, tried in turn, and how often what is taken apart is grouped anew.
ROOMS, REGROUPINGS = (2, 8, 24, CAPACITY), 4
#: Lanes in which the pieces of one length are ranked.
LANES = 256
#: Bytes of a document that are looked at together, and words a process remembers.
SLICE, REMEMBERED = 1 << 20, 600_000
BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


# ---------------------------------------------------------------- tokens


#: A character that is a word and one id of its own.
BETWEEN = "\x1f"


class _Slots(dict):
    """Numbers of words in the order in which they were met; ``new`` has those whose ids are not known yet."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = slot = len(self)
        self.new.append(word)
        return slot


class WordCodec:
    """Ids of texts by the tokenizers library, called once for each word.

    The vocabulary drops white space, and no rule of it reaches over a blank or over a border between an ASCII letter or digit
    and an ASCII mark other than an apostrophe. So a text's ids are those of its words one after another. Memory holds the
    words met so far, up to a limit, and one slice of text.
    """

    def __init__(self, path: str):
        # A task has one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.between,) = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.slots = _Slots()
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self) -> None:
        """Ids of the words that were met for the first time.

        A word of lower-case ASCII letters is one word to the vocabulary's rules as it is, so its model is asked; all others go through the
        rules in one text, with a word between them that none of them contains.
        """
        words = [w.decode("utf-8", "replace") for w in self.slots.new]
        merge, pieces, mixed = self.tokenizer.model.tokenize, [], []
        for k, raw in enumerate(self.slots.new):
            plain = raw.isalpha() and raw.islower()
            pieces.append([t.id for t in merge(words[k])] if plain else [])
            if not plain:
                mixed.append(k)
        if mixed:
            text = f" {BETWEEN} ".join("" if BETWEEN in words[k] else words[k] for k in mixed)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            found = np.split(ids, np.flatnonzero(ids == self.between))
            for n, k in enumerate(mixed):
                alone = BETWEEN in words[k]
                pieces[k] = self.tokenizer.encode(words[k], add_special_tokens=False).ids if alone else (found[n][1:] if n else found[n]).tolist()
        lengths = np.array([len(x) for x in pieces], np.int64)
        ids = np.array([i for x in pieces for i in x], np.uint32)
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
        self.lengths = np.r_[self.lengths, lengths]
        self.flat = np.r_[self.flat, ids]
        self.slots.new.clear()

    def words(self, texts: list[bytes]) -> list[list[bytes]]:
        """Words of each text, lower-cased; a text with a special token is split at its blanks only and stays as it is."""
        joined = b" ".join(texts)
        low = joined.lower()
        data = np.frombuffer(low, np.uint8)
        kinds = KINDS[data]
        borders = np.flatnonzero(kinds[1:] + kinds[:-1] == LETTER + MARK) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        ends += np.searchsorted(borders, ends)
        spaced, out, begin = np.insert(data, borders, 0x20).tobytes(), [], 0
        odd = any(token in low for token in self.special)
        for text, end in zip(texts, ends.tolist(), strict=True):
            whole = odd and any(token in text.lower() for token in self.special)
            out.append(text.split() if whole else spaced[begin:end].split())
            begin = end
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each of some texts, or of parts of texts that were cut at blanks."""
        if len(self.slots) > REMEMBERED:
            self.clear()
        split = self.words(texts)
        at = np.fromiter(map(self.slots.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))
        if self.slots.new:
            self._learn()
        counts = self.lengths[at]
        begins = np.r_[0, np.cumsum(counts)]
        steps = np.arange(begins[-1]) - np.repeat(begins[:-1], counts)
        flat = self.flat[np.repeat(self.starts[at], counts) + steps]
        ends = begins[np.cumsum([len(own) for own in split])] if split else []
        return np.split(flat, ends[:-1]) if split else []


#: Kinds of bytes that matter for borders; blanks, apostrophes, control characters and bytes of other characters are none.
LETTER, MARK = 1, 2
KINDS = np.zeros(256, np.uint8)
KINDS[[b for b in range(128) if chr(b).isalnum()]] = LETTER
KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = MARK


def parts(text: bytes) -> Iterator[bytes]:
    """A text cut at blanks into parts of about a slice; an empty text is one part."""
    lo = 0
    while lo + SLICE < len(text):
        cut = BLANK.search(text, lo + SLICE)
        if not cut:
            break
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:]


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """The process's codec, so that words met in earlier tasks are known."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def pieces(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids`` of every document: its ids and the end id, cut where it is longer than a sequence.

    Null counts as empty and is the end id alone. The CRC-32 is that of the ids as little-endian unsigned 32-bit numbers.
    """
    schema = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, ids array<int>"

    def table(rows: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
        ids, names, numbers, starts, lengths = [], [], [], [], []
        for doc_id, own in rows:
            for k, lo in enumerate(range(0, len(own), capacity)):
                part = own[lo : lo + capacity]
                ids.append(part)
                names.append(doc_id)
                numbers.append(k)
                starts.append(lo)
                lengths.append(len(part))
        offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
        sums = pa.array([zlib.crc32(part.astype("<u4")) for part in ids], pa.int64())
        columns = [pa.array(names, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), sums, lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            names, held, waiting, size = batch.column("doc_id").to_pylist(), {}, [], 0
            for row, text in enumerate(batch.column("text")):
                for part in parts(text.as_py()):
                    waiting.append((row, part))
                    size += len(part)
                    if size < SLICE:
                        continue
                    keep(held, waiting, own)
                    waiting, size = [], 0
                    if len(held) > 1:
                        # The last document may go on in the next slice.
                        yield table([(names[k], whole(held.pop(k))) for k in sorted(held)[:-1]])
            keep(held, waiting, own)
            if held:
                yield table([(names[k], whole(held[k])) for k in sorted(held)])

    def keep(held: dict[int, list[np.ndarray]], waiting: list[tuple[int, bytes]], own: WordCodec) -> None:
        for (row, _), ids in zip(waiting, own.encode([part for _, part in waiting]), strict=True):
            held.setdefault(row, []).append(ids)

    def whole(found: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([*found, np.array([END], np.uint32)])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- the plan


#: What a sequence is made of: (length, how many of it) in the order in which they lie.
MakeUp = tuple[tuple[int, int], ...]


def group_sizes(counts: np.ndarray, large: int, groups: int) -> list[list[tuple[int, int]]]:
    """Large lengths in falling order cut into groups of equally many pieces, as (length, pieces) runs."""
    total = int(counts[large + 1 :].sum())
    share = -(-total // groups) if total else 1
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in range(len(counts) - 1, large, -1):
        left = int(counts[length])
        while left:
            if not room:
                out.append([])
                room = share
            taken = min(left, room)
            out[-1].append((length, taken))
            left, room = left - taken, room - taken
    return out


def _knapsack(sizes: list[int], prices: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill a sequence with the highest sum of prices."""
    order = [k for k in np.argsort(-prices / np.array(sizes), kind="stable").tolist() if prices[k] > 1e-12]
    best, which = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in order:
        size, price = sizes[k], prices[k]
        # Copies of one size follow each other in steps of that size; at most ``capacity // size`` of them fit.
        for _ in range(capacity // size):
            tried = best[:-size] + price
            better = tried > best[size:] + 1e-12
            if not better.any():
                break
            best[size:][better] = tried[better]
            which[size:][better] = k
    taken, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if which[room] < 0 or (room and best[room] == best[room - 1]):
            room -= 1
            continue
        taken[which[room]] += 1
        room -= sizes[which[room]]
    return taken


def configurations(sizes: list[int], demand: list[int], capacity: int = CAPACITY, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in a solution of the linear programme "cover the demand with fewest sequences"."""
    n = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    wanted = np.array(demand, float)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(n))
        new = _knapsack(sizes, prices, capacity).astype(float)
        if new @ prices <= 1 + 1e-9:
            break
        step, level = np.linalg.solve(basis, new), np.linalg.solve(basis, wanted)
        ratio = np.where(step > 1e-9, np.maximum(level, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    level = np.linalg.solve(basis, wanted)
    return [(basis[:, k].round().astype(np.int64), float(level[k])) for k in range(n) if level[k] > 1e-9]


@dataclass
class _Open:
    """Sequences that still have room, by their room: make-up and how many sequences have it."""

    capacity: int

    def __post_init__(self):
        self.by_room: list[list[tuple[MakeUp, int]]] = [[] for _ in range(self.capacity + 1)]

    def add(self, make_up: MakeUp, sequences: int) -> None:
        if sequences:
            self.by_room[_room(make_up, self.capacity)].append((make_up, sequences))

    def best_fit(self, length: int, count: int) -> None:
        """Put ``count`` pieces of a length, one after another, where the least room is left; a sequence that fits best goes on doing so until it is full."""
        for room in range(length, self.capacity + 1):
            each = room // length
            here = self.by_room[room]
            while count and here:
                make_up, sequences = here.pop()
                whole = min(sequences, count // each)
                self.add((*make_up, (length, each)), whole)
                count, sequences = count - whole * each, sequences - whole
                if sequences and count:
                    self.add((*make_up, (length, count)), 1)
                    count, sequences = 0, sequences - 1
                if sequences:
                    here.append((make_up, sequences))
                    break
            if not count:
                return
        each = self.capacity // length
        self.add(((length, each),), count // each)
        if count % each:
            self.add(((length, count % each),), 1)

    def all(self) -> list[tuple[MakeUp, int]]:
        return [entry for held in self.by_room for entry in held]


def _substituted(taken: np.ndarray, want: int, waiting: list[list[tuple[int, int]]]) -> Iterator[tuple[MakeUp, int]]:
    """Sequences of one configuration with actual lengths in its places: each place takes a run of its group, the longest first."""
    places = [k for k in range(len(taken)) for _ in range(int(taken[k]))]
    runs = []
    for k in places:
        run, missing = [], want
        while missing:
            length, n = waiting[k].pop(0)
            moved = min(n, missing)
            run.append([length, moved])
            missing -= moved
            if moved < n:
                waiting[k].insert(0, (length, n - moved))
        runs.append(run)
    while runs[0]:
        alike = min(run[0][1] for run in runs)
        lengths = sorted((run[0][0] for run in runs), reverse=True)
        yield tuple((x, lengths.count(x)) for x in dict.fromkeys(lengths)), alike
        for run in runs:
            run[0][1] -= alike
            if not run[0][1]:
                run.pop(0)


def _room(make_up: MakeUp, capacity: int) -> int:
    return capacity - sum(length * n for length, n in make_up)


def _plan(counts: np.ndarray, capacity: int, groups: int, room: int) -> list[tuple[MakeUp, int]]:
    """One plan. Sequences that substitution leaves with more than ``room`` are taken apart, and their pieces are grouped anew."""
    left, opened, large = counts.copy(), _Open(capacity), capacity // LARGE_SHARE
    for _ in range(REGROUPINGS if room < capacity else 1):
        grouped = group_sizes(left, large, groups)
        if not grouped:
            break
        waiting, used = [list(g) for g in grouped], 0
        for taken, level in configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], capacity):
            want = int(level + 1e-6)
            for k in np.flatnonzero(taken):
                want = min(want, sum(n for _, n in waiting[k]) // int(taken[k]))
            for make_up, sequences in _substituted(taken, want, waiting) if want else ():
                if _room(make_up, capacity) <= room:
                    opened.add(make_up, sequences)
                    used += sequences
                    for length, n in make_up:
                        left[length] -= n * sequences
        if not used:
            break
    for length in range(capacity, 0, -1):
        if left[length]:
            opened.best_fit(length, int(left[length]))
    return opened.all()


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[MakeUp, int]]:
    """Make-ups of all sequences and how many have each, for ``counts[length]`` pieces of every length up to ``capacity``.

    Plans are made for several bounds of the room a sequence may have before small pieces come; the one with fewest sequences is taken.
    """
    cut = counts.astype(np.int64).copy()
    full, cut[capacity] = int(cut[capacity]), 0
    tried = [_plan(cut, capacity, groups, room) for room in ROOMS if room <= capacity] or [_plan(cut, capacity, groups, capacity)]
    best = min(tried, key=lambda planned: sum(n for _, n in planned))
    return ([(((capacity, 1),), full)] if full else []) + best


@dataclass
class Places:
    """Where the pieces of each length lie: for a run of ranks, the first sequence, the offset there, and how many lie in one sequence."""

    keys: np.ndarray  # length and first rank of the run, sorted
    first_rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray

    RANK_BITS = 48

    @classmethod
    def of(cls, planned: list[tuple[MakeUp, int]]) -> Places:
        ranks: dict[int, int] = {}
        rows, first = [], 0
        for make_up, sequences in planned:
            offset = 0
            for length, each in make_up:
                rank = ranks.get(length, 0)
                rows.append((length << cls.RANK_BITS | rank, rank, first, offset, each))
                ranks[length] = rank + each * sequences
                offset += length * each
            first += sequences
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return cls(*table.T)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these ranks among those of their length."""
        at = np.searchsorted(self.keys, length << self.RANK_BITS | rank, "right") - 1
        inside = rank - self.first_rank[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


# ---------------------------------------------------------------- whole tables


def _placed(length: Column, rank: Column, places: Places) -> Column:
    @arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def run(length: pa.Array, rank: pa.Array) -> pa.Array:
        found = places.find(length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["sequence_id", "offset"])

    return run(length, rank)


def pack(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset`` of every piece of every document.

    With ``ids`` false the ids stay in the written table: they are neither shuffled nor returned.

    Only documents longer than a sequence are cut. Null text counts as empty; a null ``doc_id`` and repeated rows are documents like any
    other. An empty table gives no rows. Pieces of a length are ranked in lanes by where they lie in the written table, so that
    neither a very common length nor an often repeated id is ranked by one task, and a task that runs again ranks them alike.
    """
    cut = stored(pieces(docs, path, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row.length] = row.n
    places = Places.of(plan(counts, capacity))
    where = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    lanes = (cut if ids else cut.drop("ids")).select("*", *where).withColumn("lane", F.pmod(F.xxhash64("file", "row"), F.lit(LANES)))
    light = lanes.groupBy("length", "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    begins = light.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "lane").orderBy("file", "row")
    ranked = lanes.withColumn("rank", F.row_number().over(inside) - 1).join(begins, ["length", "lane"])
    place = _placed(F.col("length"), F.col("earlier") + F.col("rank"), places)
    carried = [c for c in cut.columns if ids or c != "ids"]
    return ranked.withColumn("at", place).select(*carried, "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of each sequence; no more than a sequence's ids come together."""
    own = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda s: s["ids"])).alias("ids"))
