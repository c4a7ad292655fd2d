"""Splitting text into the words of a byte-level BPE vocabulary, with arrays over many documents at once.

The pattern of such vocabularies is: a contraction, or an optional space and a run of letters, numbers or other characters, or
white space; of white space before a word all but the last character comes first. Here the borders are found by
comparing the classes of neighbouring characters, and each word gets a 64-bit hash, so that only words not seen before need
any work of their own.
"""

from __future__ import annotations

import functools
import hashlib
import os
import unicodedata
from collections.abc import Callable

import numpy as np
from tokenizers.pre_tokenizers import ByteLevel

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: White space of Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters after an apostrophe that make a contraction.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")
RADIX = 0x9E3779B97F4A7C15
#: Radix of the words' hashes; it differs from process to process, so that no text can be made to collide.
SECRET = int.from_bytes(os.urandom(8), "little") | 1
#: Longer words get a cryptographic hash: powers of a radix modulo 2^64 are weak over long distances.
LONG_WORD = 32


@functools.cache
def character_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(c))[0])
        if kind is not None:
            table[c] = kind
    table[WHITE] = SPACE
    for c in _newer_characters():
        table[c[0] : c[1]] = c[2]
    return table


def _newer_characters() -> list[tuple[int, int, int]]:
    """Ranges of letters and numbers, with their class, among the characters that Python's tables do not have yet.

    The tokenizers library may know a later Unicode version; its own splitter is asked: neighbours of one class stay together.
    """
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    unknown = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    found = []
    for _, (a, b) in split("".join(map(chr, unknown))):
        first = chr(unknown[a])
        kind = LETTER if len(split("a" + first)) == 1 else NUMBER if len(split("1" + first)) == 1 else OTHER
        if kind != OTHER:
            found += [(c, c + 1, kind) for c in unknown[a:b]]
    return found


@functools.cache
def character_hashes() -> np.ndarray:
    """A well-mixed number for each code point."""
    x = (np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(RADIX)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(bits: int, radix: int = RADIX) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(1 << bits, np.uint64)
    ones[1:] = np.uint64(radix)
    back = np.ones(1 << bits, np.uint64)
    back[1:] = np.uint64(pow(radix, -1, 1 << 64))
    return np.cumprod(ones), np.cumprod(back)


class Words:
    """Words of some documents: ``hashes`` of each, ``of_doc`` with the first word of each document and the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, special: str):
        raw = data.tobytes()
        cuts, marked = offsets, np.zeros(0, np.int64)
        mark = special.encode()
        if mark and mark in raw:
            cuts, marked = _cut(raw, offsets, mark)
        try:
            text = raw.decode("utf-8")
            firsts = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            at = firsts[cuts]
        except UnicodeDecodeError:
            parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            text, at = "".join(parts), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
        self.text = text
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = _starts(chars, at, marked)
        self.starts = np.flatnonzero(starts)
        self.ends = np.r_[self.starts[1:], len(chars)] if len(self.starts) else self.starts
        up, down = _powers(max(16, len(chars).bit_length()), SECRET)
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(character_hashes()[chars] * up[: len(chars)], out=total[1:])
        self.hashes = (total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64)
        for k in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
            own = text[self.starts[k] : self.ends[k]].encode("utf-8", "replace")
            self.hashes[k] = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little")
        if len(marked):
            self.hashes[np.searchsorted(self.starts, at[marked])] = SPECIAL
        by_piece = np.searchsorted(self.starts, at)
        self.of_doc = by_piece if cuts is offsets else by_piece[np.searchsorted(cuts, offsets, "left")]

    def word(self, k: int) -> str:
        return self.text[self.starts[k] : self.ends[k]]


#: Hash of the special token.
SPECIAL = np.uint64(1)


def _cut(raw: bytes, offsets: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with further cuts around each special token inside a document, and which pieces are such tokens."""
    found, cuts = [], set(offsets.tolist())
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        at = raw.find(mark, a, b)
        while at >= 0:
            found.append(at)
            cuts |= {at, at + len(mark)}
            at = raw.find(mark, at + len(mark), b)
    ordered = np.array(sorted(cuts), np.int64)
    return ordered, np.searchsorted(ordered, found)


def _starts(chars: np.ndarray, at: np.ndarray, marked: np.ndarray) -> np.ndarray:
    n = len(chars)
    starts = np.zeros(n, bool)
    if not n:
        return starts
    kind = character_classes()[chars]
    opens = np.zeros(n + 1, bool)
    opens[at] = True
    first, last = opens[:n], opens[1:]
    change = np.r_[True, kind[1:] != kind[:-1]] | first
    white = kind == SPACE
    blank = np.r_[False, chars[:-1] == 0x20] & ~first  # a plain space before, in the same document
    starts |= change & (white | ~blank)
    # White space before a word: its last character is cut off; a plain space then belongs to the word.
    starts |= white & ~last & ~np.r_[white[1:], False]
    quote = np.flatnonzero((chars == 0x27) & change & ~blank)
    if len(quote):
        padded = np.r_[chars, np.zeros(3, np.uint32)]
        fence = np.r_[first, np.ones(3, bool)]  # no contraction over the end of a document
        for tail in (*SHORT, *LONG):
            hit = quote
            for k, letter in enumerate(tail, 1):
                hit = hit[(padded[hit + k] == ord(letter)) & ~fence[hit + k]]
            starts[hit + 1] = False
            after = hit + 1 + len(tail)
            starts[after[after < n]] = True
    if len(marked):
        for piece in marked.tolist():
            starts[at[piece] : at[piece + 1]] = False
            starts[at[piece]] = True
    return starts


class WordTable:
    """Ids of words met so far, found by hash. Emptied when full, so memory is bounded."""

    LIMIT = 800_000
    #: Places of the first, unsorted table; words that miss theirs are looked for in the sorted one.
    PLACES = np.uint64((1 << 20) - 1)

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special_id: int):
        self.encode, self.special_id = encode, special_id
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.array([SPECIAL]), np.zeros(1, np.int64)
        self.starts, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.flat = np.array([self.special_id], np.int64)
        self.near_hashes = np.zeros(int(self.PLACES) + 1, np.uint64)
        self.near_slots = np.zeros(int(self.PLACES) + 1, np.int64)

    def find(self, words: Words) -> np.ndarray:
        """Slot of each word."""
        if len(self.hashes) > self.LIMIT:
            self.clear()
        places = words.hashes & self.PLACES
        slots = self.near_slots[places]
        far = np.flatnonzero(self.near_hashes[places] != words.hashes)
        asked = words.hashes[far]
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        slots[far] = self.slots[at]
        missed = far[self.hashes[at] != asked]
        if len(missed):
            new, where, back = np.unique(words.hashes[missed], return_index=True, return_inverse=True)
            flat, lengths = self.encode([words.word(k) for k in missed[where].tolist()])
            added = np.arange(len(self.starts), len(self.starts) + len(new))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
            self.lengths = np.r_[self.lengths, lengths]
            self.flat = np.r_[self.flat, flat]
            place = np.searchsorted(self.hashes, new)
            self.hashes = np.insert(self.hashes, place, new)
            self.slots = np.insert(self.slots, place, added)
            slots[missed] = added[back]
            self.near_hashes[new & self.PLACES] = new
            self.near_slots[new & self.PLACES] = added
        return slots

    def ids(self, slots: np.ndarray) -> np.ndarray:
        """Ids of a row of words, one after another."""
        counts = self.lengths[slots]
        steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.flat[np.repeat(self.starts[slots], counts) + steps]
