"""Packing: tokens against the library, places against the rules, numbers of sequences against bounds."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanespan.llm import packing


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def histogram(lengths, capacity=2048):
    return np.bincount(lengths, minlength=capacity + 1)


def plain_best_fit(lengths, capacity=2048):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def check(rows, texts, library, capacity=2048):
    """Every id of every document lies in exactly one place, and sequences have no gaps and no overlap."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in texts.items():
        own = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        ids = library(text) + [packing.END]
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == list(range(0, len(ids), capacity))
        assert [k for r in own for k in r.ids] == ids and all(r.length == len(r.ids) for r in own)
    assert not by_doc
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_whole_table(spark, sample_docs, library):
    rows = packing.pack(sample_docs.repartition(5)).collect()
    n = check(rows, {r.doc_id: r.text for r in sample_docs.collect()}, library)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_documents(spark, make_docs, odd, library):
    texts = [*odd, "A\x0bB\x0cC\x1cd\x85E F", "Ünïcödé  ́x <|startoftext|>Y<|endoftext|> ΣΑΣ İ ǆ", "it's we'LL don't"]
    rows = packing.pack(make_docs(texts, extra=True)).collect()
    check(rows, dict(enumerate(texts)), library)
    assert packing.pack(make_docs([])).collect() == []


def test_repeated_rows_and_null_ids_are_documents(spark, make_docs):
    rows = packing.pack(make_docs([(7, "one two")] * 30 + [(None, "three")] * 3)).collect()
    assert len(rows) == 33 and len({(r.sequence_id, r.offset) for r in rows}) == 33


def test_every_character_between_blanks(library):
    """Runs between blanks have the ids that they have within the whole text."""
    codec = packing.WordCodec(packing.VOCABULARY)
    for lo in range(0, 0x3400, 16):
        text = "a ".join(f"{chr(c)}b C{chr(c)} \t{chr(c)}" for c in range(lo, lo + 16))
        assert codec.encode([text.encode()])[0].tolist() == library(text), hex(lo)


def test_borders_inside_words(library):
    """Any neighbours of letters, digits, marks, apostrophes and other characters, in every order of four."""
    rng = np.random.default_rng(4)
    signs = list("aZs0't!-<|>_~$é́… \x7f") + ["'ll", "'RE", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x1f", " \x1f "]
    codec = packing.WordCodec(packing.VOCABULARY)
    texts = ["".join(rng.choice(signs, 60)) for _ in range(2000)]
    for text, ids in zip(texts, codec.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library(text), repr(text)


def test_slices_of_a_long_text(library, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 64)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    text = " ".join(f"word{k % 97} it's\n{k}" for k in range(2000)) + "x" * 500
    codec = packing.WordCodec(packing.VOCABULARY)
    cut = list(packing.parts(text.encode()))
    assert len(cut) > 50 and b"".join(cut) == text.encode()
    assert np.concatenate([codec.encode([part])[0] for part in cut]).tolist() == library(text)
    assert list(packing.parts(b"")) == [b""] and codec.encode([]) == []


def test_documents_over_several_slices(spark, make_docs, library, monkeypatch):
    texts = ["one two " * 30, "", "x " * 500, None, "short", "y " * 90]
    monkeypatch.setattr(packing, "SLICE", 100)
    rows = packing.pack(make_docs(texts).coalesce(1)).collect()
    check(rows, dict(enumerate(texts)), library)


@pytest.mark.parametrize("low, high, n", [(1, 2049, 400), (257, 900, 400), (600, 1100, 300), (1, 30, 3000), (1, 2, 5000), (700, 720, 100), (2048, 2049, 9)])
def test_plan_is_exact_and_short(low, high, n):
    lengths = np.random.default_rng(n).integers(low, high, n)
    counts = histogram(lengths)
    planned = packing.plan(counts)
    found = np.zeros(2049, np.int64)
    for make_up, sequences in planned:
        assert sum(length * k for length, k in make_up) <= 2048
        for length, k in make_up:
            found[length] += k * sequences
    assert (found == counts).all()
    assert sum(s for _, s in planned) <= plain_best_fit(lengths.tolist()) + 1


def test_plan_grows_by_counts_alone():
    counts = histogram(np.random.default_rng(1).integers(1, 2049, 5000))
    planned = packing.plan(counts * 10**9)
    assert sum(s * sum(length * k for length, k in m) for m, s in planned) == int((counts * np.arange(2049)).sum()) * 10**9
    assert packing.plan(histogram([])) == []


def test_knapsack_and_configurations():
    taken = packing._knapsack([900, 700, 400], np.array([0.5, 0.36, 0.2]), 2048)
    assert taken.tolist() == [1, 1, 1]
    used = packing.configurations([1000, 500], [10, 10])
    assert abs(sum(level for _, level in used) - 7.5) < 1e-6 and all((np.array([1000, 500]) @ c) <= 2048 for c, _ in used)


def test_groups_have_equal_numbers():
    groups = packing.group_sizes(histogram([300] * 7 + [900] * 2 + [1500] * 3), 256, 4)
    assert [sum(n for _, n in g) for g in groups] == [3, 3, 3, 3] and groups[0] == [(1500, 3)] and groups[1] == [(900, 2), (300, 1)]


def test_sequences_and_digests(spark, make_docs):
    packed = packing.pack(make_docs(["one two three", "four", None, "five six"] * 5)).cache()
    (whole,) = packing.sequences(packed).collect()
    rows = packed.collect()
    assert len(whole.ids) == sum(r.length for r in rows)
    for r in rows:
        assert whole.ids[r.offset : r.offset + r.length] == list(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert packed.agg(F.sum("length")).first()[0] == len(whole.ids)
