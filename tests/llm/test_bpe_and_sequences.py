"""Encoding against the tokenizers library; files read back against what was written."""

import hashlib
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from lanespan.llm import bpe, pretokens, sequences
from lanespan.llm.common import slices

LIBRARY = Tokenizer.from_file(bpe.VOCABULARY)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def coded(texts):
    own = bpe.codec(bpe.VOCABULARY)
    column = pa.array([t.encode() for t in texts], pa.binary())
    return [row for _, _, data, offsets in slices(column, bpe.SLICE) for row in own.documents(data, offsets)]


ALPHABET = st.sampled_from(list("aabbest'stmdrevlI  \n\t1९½.!?-_éßÉ日語😀 　́\x00") + ["<|endoftext|>", "  ", "'ll", "'S"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=40).map("".join), min_size=1, max_size=5))
def test_ids_and_round_trip_equal_the_library(texts):
    for text, (n, printed, decoded) in zip(texts, coded(texts), strict=True):
        ids = library(text)
        assert n == len(ids)
        assert printed.decode() == ",".join(map(str, ids))
        assert decoded.decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


def test_every_character_is_split_as_the_library_splits_it():
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3100 or c % 97 == 0 or unicodedata.category(chr(c)) == "Cn" and c < 0x32000)]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for text, (_, printed, _) in zip(texts, coded(texts), strict=True):
        assert printed.decode() == ",".join(map(str, library(text)))


def test_class_of_every_character_is_the_librarys():
    """Neighbours of one class are one word of the library's splitter, so its borders in a row of all characters are the changes of class."""
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and c not in pretokens.WHITE and c != 0x27])
    kinds = pretokens.character_classes()[points]
    borders = [a for _, (a, _) in split("".join(map(chr, points.tolist())))]
    assert borders == np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]).tolist()
    for first in (a for a in borders if kinds[a] != pretokens.OTHER):
        assert len(split(("a" if kinds[first] == pretokens.LETTER else "1") + chr(points[first]))) == 1


def test_words_with_equal_powers_do_not_collide():
    """Of the Thue-Morse word and its complement every polynomial hash modulo 2^64 is the same."""
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: "b", 98: "a"})
    texts = [word, word.translate({97: "b", 98: "a"}), word[:1024], word[1024:2048], word[:32] + " " + word[32:64]]
    for text, (_, printed, _) in zip(texts, coded(texts), strict=True):
        assert printed.decode() == ",".join(map(str, library(text)))


def test_very_long_words(monkeypatch):
    rng = np.random.default_rng(6)
    long = ["".join(rng.choice(list("abcdefghij"), n)) for n in (1000, 1500, 60_000)] + ["é" * 700, "ab" * 900, "a" * 3001, "word"]
    flat, lengths = bpe.vocabulary(bpe.VOCABULARY).encode_words(long)
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == [library(w) for w in long]
    monkeypatch.setattr(bpe, "LONG", 1)
    words = ["a" * n for n in range(1, 40)] + ["ab" * 9, "aab" * 7, "the quick"]
    flat, lengths = bpe.vocabulary(bpe.VOCABULARY).encode_words(words)
    assert flat.tolist() == [i for w in words for i in library(w)]


def test_overlapping_pairs_merge_from_the_left():
    words = ["a" * n for n in range(1, 40)] + ["ab" * 9, "aab" * 7]
    flat, lengths = bpe.vocabulary(bpe.VOCABULARY).encode_words(words)
    assert np.split(flat, np.cumsum(lengths)[:-1])[5].tolist() == library("a" * 6)
    assert flat.tolist() == [i for w in words for i in library(w)]


def test_word_table_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe.WordTable, "LIMIT", 50)
    own = bpe.Codec(bpe.VOCABULARY)
    for k in range(5):
        text = " ".join(f"word{k}{i}" for i in range(100)).encode()
        ids, _ = own.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == library(text.decode())


def test_round_trip_table(make_docs, odd):
    rows = bpe.round_trip(make_docs(odd, extra=True)).collect()
    assert len(rows) == len(odd)
    for r in rows:
        ids = library(odd[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((odd[r.doc_id] or "").encode()).hexdigest()


def test_encode_then_decode(make_docs, odd):
    found = {r.doc_id: r.text for r in bpe.decode(bpe.encode(make_docs(odd))).collect()}
    assert found == {i: t or "" for i, t in enumerate(odd)}


def test_empty_tables(make_docs):
    assert bpe.round_trip(make_docs([])).count() == 0
    assert sequences.encode_and_read(make_docs([])).count() == 0


@pytest.mark.parametrize("repeat", [1, 3])
def test_files_hold_all_documents_in_order(make_docs, odd, repeat):
    texts = odd * repeat
    rows = sorted(sequences.encode_and_read(make_docs(texts, extra=True)).collect())
    start = 0
    for r, text in zip(rows, texts, strict=True):
        ids = np.array(library(text) + [sequences.END_ID], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_repeated_and_null_ids(make_docs):
    rows = sequences.encode_and_read(make_docs([(None, "x"), (3, "b"), (3, "a"), (3, "a"), (1, None)])).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 3, 3, 3]
    assert rows[2].ids_crc32 == rows[3].ids_crc32 != rows[4].ids_crc32


def test_sequences_are_equally_long_and_masked_at_the_end(tmp_path):
    path = str(tmp_path / "ids.arrow")
    ids = np.arange(sequences.LENGTH * sequences.ROWS * 2 + 700) % 50_000
    with pa.OSFile(path, "wb") as sink:
        out = sequences.SequenceWriter(sink, pa.uint16())
        for part in np.array_split(ids, 37):
            out.add(part)
        out.close()
    file = sequences.SequenceFile(path)
    assert file.batches() == 3
    assert (file.source.size() - file.begin - 8) % file.stride == 0
    for i in (0, 5, 130, 256):
        found, mask = file.sequence(i)
        want = ids[i * sequences.LENGTH : (i + 1) * sequences.LENGTH]
        assert len(found) == len(mask) == sequences.LENGTH
        assert found[: len(want)].tolist() == want.tolist() and mask.sum() == len(want)
    assert file.ids(100_000, 140_000).tolist() == ids[100_000:140_000].tolist()
    with pytest.raises(ValueError):
        file.ids(len(ids) - 1, len(ids) + 1)
    with pytest.raises(IndexError):
        file.batch(3)
