"""Byte-level BPE encoding and decoding by merge rounds over arrays.

The symbols of many words lie in one flat array. In each round every word finds the lowest rank among its neighbouring pairs
- ranks come from a binary search over the sorted keys of all merges - and merges all pairs of that rank, the leftmost
first where they overlap. A merged symbol only makes pairs of a higher rank, so a round equals the same merges one by one.
Words without a pair left leave the array. A very long word would take a round for each of its many ranks; it goes through a queue of
its pairs instead.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanespan.llm.common import slices, text_bytes
from lanespan.llm.pretokens import Words, WordTable

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
NO_PAIR = np.int64(1 << 40)
#: Bytes of text whose words are split at a time.
SLICE = 2 << 20
#: Bytes of a word that is merged by itself.
LONG = 1024


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        ids, merges = content["model"]["vocab"], content["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        alphabet = byte_alphabet()
        self.byte_ids = np.array([ids[c] for c in alphabet], np.int64)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)  # by rank
        self.rank_of: dict[int, int] | None = None  # for long words, made when one comes
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.special_token, self.special_id = next(iter(self.special.items()), ("", 0))
        byte_of = {c: b for b, c in enumerate(alphabet)}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, k in ids.items():
            self.pieces[k] = bytes(byte_of[c] for c in token)
        for token, k in self.special.items():
            self.pieces[k] = token.encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_PAIR)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word."""
        raw = [w.encode("utf-8", "replace") for w in words]
        long = [k for k, r in enumerate(raw) if len(r) > LONG]
        if long:
            return self._with_long(words, raw, long)
        sizes = np.array([len(r) for r in raw], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        done_symbols, done_words = [], []
        ranks = np.full(len(symbols), NO_PAIR)
        inside = np.flatnonzero(word[1:] == word[:-1])
        ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[first, len(symbols)])
            best = np.minimum.reduceat(ranks, first)
            over = np.repeat(best == NO_PAIR, lengths)
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                stay = ~over
                symbols, word, ranks = symbols[stay], word[stay], ranks[stay]
                kept = best != NO_PAIR
                best, lengths = best[kept], lengths[kept]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(ranks == np.repeat(best, lengths))
            # Of pairs that overlap, every second one from the left.
            run = np.r_[True, np.diff(chosen) != 1]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - begin) % 2 == 0]
            symbols[chosen] = self.merged[ranks[chosen]]
            stay = np.ones(len(symbols), bool)
            stay[chosen + 1] = False
            ranks[chosen] = NO_PAIR
            symbols, word, ranks = symbols[stay], word[stay], ranks[stay]
            now = chosen - np.arange(len(chosen))
            near = np.zeros(len(symbols) + 1, bool)
            near[now] = near[now - 1] = True
            touched = np.flatnonzero(near[: len(symbols) - 1])
            same = word[touched] == word[touched + 1]
            ranks[touched] = NO_PAIR
            pairs = touched[same]
            ranks[pairs] = self.rank(symbols[pairs], symbols[pairs + 1])
            if len(now) and now[-1] == len(symbols) - 1:
                ranks[-1] = NO_PAIR
        flat = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        owner = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(raw)).astype(np.int64)

    def _with_long(self, words: list[str], raw: list[bytes], long: list[int]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = self.encode_words(["" if len(r) > LONG else w for w, r in zip(words, raw, strict=True)])
        pieces = np.split(flat, np.cumsum(lengths)[:-1])
        for k in long:
            pieces[k] = self._merge_by_queue(self.byte_ids[np.frombuffer(raw[k], np.uint8)])
        return np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)

    def _merge_by_queue(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one word: the pair of lowest rank, the leftmost first, is merged again and again."""
        ranks = self.rank(symbols[:-1], symbols[1:])
        queue = [(r, k) for k, r in enumerate(ranks.tolist()) if r < NO_PAIR]
        heapq.heapify(queue)
        ids, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        if self.rank_of is None:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        rank_of, merged = self.rank_of.get, self.merged.tolist()
        while queue:
            rank, k = heapq.heappop(queue)
            right = after[k]
            # An entry counts only if its pair is still there.
            if ids[k] < 0 or right >= n or rank_of(ids[k] << 32 | ids[right]) != rank:
                continue
            ids[k], ids[right] = merged[rank], -1
            beyond = after[k] = after[right]
            if beyond < n:
                before[beyond] = k
                found = rank_of(ids[k] << 32 | ids[beyond])
                if found is not None:
                    heapq.heappush(queue, (found, k))
            left = before[k]
            if left >= 0:
                found = rank_of(ids[left] << 32 | ids[k])
                if found is not None:
                    heapq.heappush(queue, (found, left))
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a row of ids, special tokens included."""
        return b"".join([self.pieces[k] for k in ids.tolist()])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Codec:
    """Encodes documents and decodes their ids; words met before need no merging."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.table = WordTable(self.vocabulary.encode_words, self.vocabulary.special_id)
        self.printed = [b"%d" % k for k in range(len(self.vocabulary.pieces))]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some documents in one array, and where each document begins."""
        words = Words(data, offsets, self.vocabulary.special_token)
        slots = self.table.find(words)
        return self.table.ids(slots), np.r_[0, np.cumsum(self.table.lengths[slots])][words.of_doc]

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """Number of ids, ids in print joined by commas, and decoded bytes of each document."""
        ids, begins = self.encode(data, offsets)
        printed, pieces, begins = self.printed, self.vocabulary.pieces, begins.tolist()
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            own = ids[a:b].tolist()
            yield b - a, b",".join([printed[k] for k in own]), b"".join([pieces[k] for k in own])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The process's codec, so that words met in earlier tasks need no new merging."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every row: the ids of its whole text. Null counts as empty and has no ids."""
    schema = "doc_id bigint, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text"), SLICE):
                ids, begins = own.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of a table ``doc_id, ids``; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; nothing larger than a slice of texts is held.

    Null counts as empty: no ids, digests of the empty string. Repeated rows give repeated results.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text"), SLICE):
                counts, ids, texts = [], [], []
                for n, printed, decoded in own.documents(data, offsets):
                    counts.append(n)
                    ids.append(hashlib.sha256(printed).hexdigest())
                    texts.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
