"""Exact, near and passage dedup against plain loops."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lanespan.llm import exact_dedup, simhash, suffixes
from lanespan.llm.components import components


def index(spark, tmp_path, name="index"):
    return exact_dedup.DigestIndex(spark, str(tmp_path / name), 4)


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_groups(spark, make_docs, odd, tmp_path):
    texts = [*odd, "a b", "ab ", " a b ", "A b", "a b"]
    rows = index(spark, tmp_path).add(make_docs(texts, extra=True)).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(plain(t), []).append(i)
    for r in rows:
        own = groups[plain(texts[r.doc_id])]
        keep = min(own, key=lambda i: (-len(texts[i] or ""), i))
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), keep == r.doc_id)
        assert bytes(r.digest).hex() == hashlib.sha256(plain(texts[r.doc_id]).encode()).hexdigest()
    assert len(rows) == len(texts)


def test_index_remembers_earlier_batches(spark, make_docs, tmp_path):
    own = index(spark, tmp_path)
    own.add(make_docs([(10, "a"), (11, "b")]))
    again = index(spark, tmp_path)
    rows = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in again.add(make_docs([(1, "a "), (2, "c"), (3, "c")])).collect()}
    assert rows == {1: (10, 1, False), 2: (2, 2, True), 3: (2, 2, False)}
    assert again.rows().count() == 3
    assert again.add(make_docs([])).count() == 0


def test_index_keeps_its_buckets_under_another_setting(spark, make_docs, tmp_path):
    docs, path = make_docs([f"text {i}" for i in range(1000)]), str(tmp_path / "buckets")
    exact_dedup.DigestIndex(spark, path, 8).add(docs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == 8 and again.rows().count() == 1000
        assert again.add(docs).filter("kept").count() == 0
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, path, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_large_batch_against_a_filled_index(spark, tmp_path):
    def texts(low, high):
        return spark.range(low, high).selectExpr("id AS doc_id", "concat('text ', id % 70000) AS text")

    own = exact_dedup.DigestIndex(spark, str(tmp_path / "large"))
    assert own.add(texts(0, 50_000)).filter("kept").count() == 50_000
    rows = own.add(texts(50_000, 150_000))
    assert rows.filter("kept").count() == 20_000 and rows.count() == 100_000
    assert rows.filter("NOT kept AND keep_id < 50000").select("digest").distinct().count() == 50_000


def test_one_row_of_each_digest_stays(spark, make_docs, tmp_path):
    docs = make_docs([(5, "a"), (5, "a"), (5, "b"), (None, "c"), (None, "c"), (7, "c")], extra=True)
    kept = exact_dedup.keep_first(docs, index(spark, tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(5, "a"), (5, "b"), (7, "c")]
    assert exact_dedup.keep_first(docs.limit(0), index(spark, tmp_path, "other")).count() == 0


def test_longest_of_one_id_stays(spark, make_docs, tmp_path):
    for k, texts in enumerate((["ab", "a b", " a  b", "a b "], [" a  b", "a b", "ab"], ["a b ", "ab", " a  b", " a  b"])):
        docs = make_docs([(5, t) for t in texts]).repartition(3)
        assert [r.text for r in exact_dedup.keep_first(docs, index(spark, tmp_path, f"one{k}")).collect()] == [" a  b"]


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def naive_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def near(a, b):
    return (a ^ b).bit_count() <= simhash.LIMIT


def test_near_groups(make_docs, sample_docs, odd):
    for docs in (make_docs(odd, extra=True), sample_docs):
        texts = {r.doc_id: r.text for r in docs.collect()}
        fps = {i: naive_fingerprint(t) for i, t in texts.items()}
        want = naive_components(sorted(fps), [(a, b) for a, b in combinations(sorted(fps), 2) if near(fps[a], fps[b])])
        rows = simhash.near_groups(docs).withColumn("fingerprint", simhash.hex_fingerprint()).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("seed", range(6))
def test_gray_index_links_what_a_scan_links(spark, seed):
    rng = random.Random(seed)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(codes)[:8]:  # chains and dense groups
        at = centre
        for _ in range(60):
            at ^= 1 << rng.randrange(64) if seed % 2 else 1 << rng.randrange(6)
            codes.add(at)
            codes.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    codes = sorted(codes)
    want = naive_components(codes, [(a, b) for a, b in combinations(codes, 2) if near(a, b)])
    groups = np.zeros(len(codes), np.int64)
    tree = simhash.GrayIndex(np.array(codes, np.uint64), groups, np.zeros(len(codes), np.uint64))
    root = tree.links()
    found = {}
    for code, r in zip(tree.codes.tolist(), root.tolist(), strict=True):
        found.setdefault(r, set()).add(code)
    expected = {}
    for code, r in want.items():
        expected.setdefault(r, set()).add(code)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))
    signed = [(int(np.uint64(c).view(np.int64)),) for c in codes]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()
    by_signed = naive_components(sorted(s for (s,) in signed), [(e.high, e.low) for e in edges])
    assert len(set(by_signed.values())) == len(expected)


def test_every_near_pair_shares_a_key():
    rng = random.Random(3)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(a & m == b & m for m in simhash.KEYS)


def test_one_document_of_each_component_stays(make_docs):
    base = [f"w{i}" for i in range(400)]
    close = base[:]
    close[200] = "other"
    docs = make_docs([(9, " ".join(base)), (4, " ".join(close)), (4, " ".join(close)), (6, "quite different words here"), (7, None), (8, "")], extra=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    fps = [naive_fingerprint(" ".join(t)) for t in (base, close)]
    want = [4, 6, 7] if near(*fps) else [4, 6, 7, 9]
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_null_and_shared_ids_do_not_join_components(make_docs):
    texts = [f"document {w} speaks of {w} things and nobody else does {w * 3}" for w in ("red", "green", "blue", "grey", "pink")]
    fps = [naive_fingerprint(t) for t in texts]
    assert not any(near(a, b) for a, b in combinations(fps, 2))
    pairs = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (None, texts[4]), (8, texts[4]), (6, texts[4].upper())]
    docs = make_docs(pairs)
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[4].upper())], key=repr)


def test_components_of_long_chains_and_stars(spark):
    chain = [(i + 1, i) for i in range(120)]
    star = [(1000 + i, 999) for i in range(300)]
    pairs = [(max(a, b), min(a, b)) for a, b in chain + star]
    random.Random(1).shuffle(pairs)
    rows = components(spark.createDataFrame(pairs, "high bigint, low bigint")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(1, 121)}, **{1000 + i: 999 for i in range(300)}}
    assert components(spark.createDataFrame([], "high bigint, low bigint")).count() == 0


def naive_repeats(docs):
    first = {}
    for i, raw in sorted(docs):
        for p in range(len(raw) - suffixes.WINDOW + 1):
            first.setdefault(raw[p : p + suffixes.WINDOW], i)
    out = {}
    for i, raw in docs:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - suffixes.WINDOW + 1):
            if first[raw[p : p + suffixes.WINDOW]] < i:
                gone[p : p + suffixes.WINDOW] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def found_repeats(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect()}


def test_repeats_in_the_sample(sample_docs):
    want = naive_repeats([(r.doc_id, r.text.encode()) for r in sample_docs.collect()])
    assert found_repeats(sample_docs) == want
    assert sum(v[1] for v in want.values()) > 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_all_lengths(make_docs, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé \n") for _ in range(n)) for n in (30, 48, 49, 50, 51, 52, 75, 99, 100, 400)]
    passages += ["ab" * 60, "z" * 120]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("xyzw") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        texts.append("".join(parts))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    pairs = list(zip(ids, texts, strict=True))
    assert found_repeats(make_docs(pairs, extra=True)) == naive_repeats([(i, t.encode()) for i, t in pairs])


def test_a_line_in_every_document_and_a_long_text(make_docs, odd, monkeypatch):
    line = "this very line stands in each and every document of the whole collection, word for word"
    texts = [f"{i} {'q' * (i % 7)} {line} {i * 7919}" for i in range(120)] + odd + [odd[8][:1000], line * 3]
    assert found_repeats(make_docs(texts)) == naive_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)])


def test_pieces_of_long_texts(make_docs, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 1 << 10)
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    texts = [body, body[700:2900], "x" + body[4000:] + "y" + body[:60], body[:49], body[:50]]
    data = [t.encode() for t in texts]
    seen = sum(len(part) - suffixes.WINDOW + 1 for _, begin, _, _ in suffixes.pieces(data) for part in np.split(np.arange(begin[-1]), begin[1:-1]))
    assert seen == sum(max(0, len(t) - suffixes.WINDOW + 1) for t in data)


def test_repeated_and_null_ids_lose_nothing_to_each_other(make_docs):
    text = "a passage that is certainly longer than fifty bytes, all told, in each of them"
    rows = suffixes.remove_repeats(make_docs([(3, text), (3, text), (None, text), (3, "-" + text)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in rows) == [(False, 0), (False, 0), (False, 0), (True, len(text))]
    assert suffixes.remove_repeats(make_docs([])).count() == 0


def test_refined_buckets_are_those_of_whole_windows():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[2000:3000] = text[:1000]
    begin = np.array([0, 500, 1999, 4000])
    bucket = suffixes.refine(text, begin)
    strings = {}
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        for p in range(a, b - suffixes.WINDOW + 1):
            strings.setdefault(text[p : p + suffixes.WINDOW].tobytes(), []).append(p)
    for places in strings.values():
        ids = set(bucket[places].tolist())
        assert len(ids) == 1 and (ids == {-1}) == (len(places) == 1)
