"""Decontamination, sharding and the learned operators."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lanespan.llm import decontaminate, labelled, language, quality, sharding, toxicity
from lanespan.llm.decontaminate import WINDOW

SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SEPARATOR.split(lowered) if w]


def naive_report(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            windows[tuple(w[i : i + WINDOW])].add(str(item))
    sizes = {len(k) for k in windows}
    rows = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                own = windows.get(tuple(w[p : p + size]))
                if own:
                    found |= own
                    hit |= set(range(p, p + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(rows, key=repr)


ITEMS = [
    (2, "One two three four five six seven eight nine ten eleven twelve"),
    (10, "eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"),
    (3, "Élan vital"),
    (4, "lonely"),
    (5, "... !!"),
    (6, None),
    (7, "a b c d e"),
]


def items_table(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id bigint, text string")


def documents_with_hits():
    rng = random.Random(4)
    pool = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen a b c d e lonely Élan élan vital".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(60)]
    run = "one, two. THREE four-five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    texts += [run, "x " * rng.randrange(9) + run + " y", run[4:], " ".join(words(run)[:9]), "Élan - VITAL", "élan vital", "a b c d", "z a b c d e z"]
    return texts


def test_report(spark, make_docs, odd):
    texts = documents_with_hits() + odd
    rows = decontaminate.report(make_docs(texts, extra=True), items_table(spark)).collect()
    assert sorted(map(tuple, rows), key=repr) == naive_report(list(enumerate(texts)), ITEMS)


def test_report_without_broadcast(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    texts = documents_with_hits()
    rows = decontaminate.report(make_docs(texts), items_table(spark)).collect()
    assert sorted(map(tuple, rows), key=repr) == naive_report(list(enumerate(texts)), ITEMS)


def test_repeated_ids_and_empty_tables(spark, make_docs):
    docs = [(1, ITEMS[0][1]), (1, ITEMS[0][1]), (1, "clean"), (None, "lonely"), (None, None)]
    rows = decontaminate.report(make_docs(docs), items_table(spark)).collect()
    assert sorted(map(tuple, rows), key=repr) == naive_report(docs, ITEMS)
    assert decontaminate.report(make_docs([]), items_table(spark)).count() == 0
    rows = decontaminate.report(make_docs(docs), items_table(spark, [])).collect()
    assert [r.contaminated for r in rows] == [False] * 5


def test_removal(spark, make_docs):
    texts = [ITEMS[0][1], "Before: " + ITEMS[0][1].replace(" ", ", ") + "; after.", "clean text", None, "lonely planet", "so lonely!"]
    docs = make_docs(texts, extra=True)
    clean = decontaminate.decontaminate(docs, items_table(spark))
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items_table(spark), "spans").collect()}
    assert cut == {0: "", 1: "Before: after.", 2: "clean text", 3: None, 4: "planet", 5: "so "}
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, items_table(spark), "words")


def check_law(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 8
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    counts = [len(by[s]) for s in range(shards)]
    assert sum(counts) == len(texts) and max(counts) - min(counts) <= 1


@pytest.mark.parametrize("n", [0, 5, 24, 500])
def test_shards_are_even(make_docs, odd, n):
    rng = random.Random(n)
    texts = [f"text {rng.randrange(n)}" for _ in range(n)] + (odd if n == 500 else [])
    check_law(sharding.shard(make_docs(texts, extra=True)).collect(), texts, sharding.SHARDS)


def test_one_text_may_be_most_of_the_table(make_docs):
    texts = ["the same"] * 700 + [f"text {i}" for i in range(500)]
    check_law(sharding.shard(make_docs(texts)).collect(), texts, sharding.SHARDS)


def test_a_further_shard_moves_few_rows(make_docs):
    docs = make_docs([f"text {i}" for i in range(3000)])
    before, after = ({r.doc_id: r.shard for r in sharding.shard(docs, k).collect()} for k in (24, 25))
    assert sum(before[i] != after[i] for i in before) < 0.25 * len(before)


def walk_the_ring(nodes, rows, shards):
    """Shard and slot of every document, row by row: home first, then those beyond a bound go on clockwise to the next room."""
    bound = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    held, placed, queues = [0] * shards, {}, {}

    def put(doc_id, s):
        placed[doc_id] = (s, held[s])
        held[s] += 1

    at_place = {}
    for place, lane, doc_id in rows:
        at_place.setdefault(place, []).append((lane, doc_id))
    for _, place, arc, s in sorted((n.turn, n.place, n.arc, n.shard) for n in nodes):
        for _, doc_id in sorted(at_place.get(place, [])):
            if held[s] < bound[s]:
                put(doc_id, s)
            else:
                queues.setdefault(arc, []).append(doc_id)
    arcs, waiting = sorted({(n.arc, n.shard) for n in nodes}), []
    for arc, s in arcs * 2:
        waiting += queues.pop(arc, [])
        while waiting and held[s] < bound[s]:
            put(waiting.pop(0), s)
    assert not waiting and held == bound
    return placed


def test_shards_equal_a_walk_along_the_ring(spark, make_docs):
    texts = [f"text {i % 60}" if i % 3 else "hot" for i in range(700)]
    places = [xxhash.xxh64_intdigest(t.encode(), seed=42) % sharding.PLACES for t in texts]
    lanes = [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=42) % sharding.LANES for i in range(len(texts))]
    rows = [(p, lane, i) for i, (p, lane) in enumerate(zip(places, lanes, strict=True))]
    for shards in (7, 24):
        nodes = sharding.ring(spark, shards, sharding.NODES).collect()
        found = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(make_docs(texts), shards).collect()}
        assert found == walk_the_ring(nodes, rows, shards)


def test_equal_texts_stay_together_unless_a_shard_is_full(make_docs):
    texts = [f"text {i // 4}" for i in range(2400)]
    by = defaultdict(set)
    for r in sharding.shard(make_docs(texts)).collect():
        by[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) == 1 for s in by.values()) > 0.8 * len(by)


def auc(scores, y):
    rank = np.argsort(np.argsort(scores, kind="stable"))
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.85)])
def test_held_out_ranking(spark, module, label, least):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.classify(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).filter("held_out").join(labels, "doc_id").collect()
    y = np.array([r[label] for r in rows])
    assert all(r.predicted == int(r.score >= module.THRESHOLD) and 0 <= r.score <= 1 for r in rows)
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows} == {0}
    assert auc(np.array([r.score for r in rows]), y) >= least


@pytest.mark.parametrize("script", ["latin", "han"])
def test_toxic_phrases_of_ordinary_words(script):
    rng = random.Random(1)
    if script == "latin":
        own = [a + b for a in ("ta", "ro", "mi", "ke", "lu", "so", "ne") for b in ("l", "rn", "st", "p", "nd", "m", "ck")] + "you all should leave now your kind".split()
        phrases, between = ["you all should leave now", "your kind should leave"], " "
    else:
        own, between = [chr(0x4E00 + i) for i in range(400)], ""
        phrases = ["".join(own[3:9]), "".join(own[20:25])]
    rows = []
    for i in range(1600):
        parts = [rng.choice(own) for _ in range(rng.randrange(40, 300))]
        for _ in range(rng.randrange(1, 4) if i % 4 == 0 else 0):
            parts.insert(rng.randrange(len(parts)), rng.choice(phrases))
        rows.append((between.join(parts).encode(), int(i % 4 == 0)))
    model = toxicity.train(rows[:1000], {0: 750, 1: 250})
    assert auc(np.array([model.score(t) for t, _ in rows[1000:]]), np.array([y for _, y in rows[1000:]])) >= 0.85


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, make_docs, odd, module):
    docs = make_docs([*odd, (None, "no id")], extra=True)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = module.classify(docs, none).collect()
    assert len(rows) == len(odd) + 1 and {r.score for r in rows} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(odd))] + [(2, None, None)], "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: r for r in module.classify(docs, labels).collect()}
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert rows[0].score == rows[1].score and rows[6].score == rows[7].score
    assert rows[None].held_out is False
    assert module.classify(docs.limit(0), labels).count() == 0


def test_convolution_covers_every_position():
    rng = np.random.default_rng(1)
    shape = quality.Network(rng.normal(size=(256, quality.DEPTH)), rng.normal(size=(quality.WIDTH * quality.DEPTH, quality.FILTERS)), np.zeros(quality.FILTERS), rng.normal(size=quality.FILTERS), 0.1)
    shape.bytes_[0] = 0
    texts = [rng.integers(1, 256, n).astype(np.uint8) for n in (0, 3, 255, 256, 1024, 5000)]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    together = shape.scores(np.concatenate(texts), offsets)
    for text, found in zip(texts, together, strict=True):
        filled = np.zeros(-(-(len(text) + quality.WIDTH) // quality.BLOCK) * quality.BLOCK + quality.WIDTH, np.uint8)
        filled[: len(text)] = text
        size = (len(filled) - quality.WIDTH) // quality.BLOCK * quality.BLOCK
        seen = np.array([shape.bytes_[filled[p : p + quality.WIDTH]].ravel() @ shape.filters for p in range(0, size, quality.STRIDE)])
        seen[1 - quality.WIDTH // quality.STRIDE :] = 0  # windows that would reach over the document's end
        block = np.maximum(seen, 0).reshape(-1, quality.BLOCK // quality.STRIDE, quality.FILTERS).max(axis=1)
        chunks, k = [], 0
        while True:
            chunks.append(block[np.minimum(np.arange(k, k + quality.CHUNK), len(block) - 1)].max(axis=0))
            if k + quality.CHUNK >= len(block):
                break
            k += quality.STEP
        assert found == pytest.approx(1 / (1 + np.exp(-(np.mean(chunks, axis=0) @ shape.out + 0.1))), rel=1e-6)


def test_rejected_documents_go_and_columns_stay(spark, sample_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = sample_docs.selectExpr("*", "'x' AS score")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    passed = {r.doc_id for r in quality.classify(sample_docs, labels).collect() if r.predicted == 1}
    assert {r.doc_id for r in kept.collect()} == passed and 0 < len(passed)


def test_many_languages(spark, make_docs):
    """Labels beyond a byte, and the pass for many languages equal to the one in pieces."""
    rng = np.random.default_rng(8)
    scores, offsets = rng.normal(0, 3, (900, 6)), np.array([0, 0, 400, 401, 900])
    assert (language._word_by_word(scores, offsets, language.PENALTY) == language.viterbi(scores, offsets)).all()
    names = [f"l{k:03d}" for k in range(300)]
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in names]
    model = language.train([((w + " ").encode() * 30, n) for w, n in zip(words, names, strict=True)])
    text = (" ".join([words[7]] * 40 + [words[290]] * 30)).encode()
    ((found, _, spans),) = language.predict(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert found == "l007" and [s["lang"] for s in spans] == ["l007", "l290"]


def test_samples_are_bounded(spark, make_docs):
    """One text of each chosen id, cut before it is collected."""
    docs = make_docs([(7, f"{k} " + "long text " * 20_000) for k in range(6)] + [(9, "short"), (9, "short")])
    labels = spark.createDataFrame([(7, 1, 1), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows, counts = labelled.sample(docs, labels, "quality", 5, 7, 10)
    assert counts == {0: 1, 1: 1} and [(len(t), y) for t, y in rows] == [(labelled.FIT_BYTES, 1), (5, 0)]


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = rng.integers(0, 500, 4)
        offsets = np.r_[0, np.cumsum(counts)]
        scores = rng.normal(0, 3, (offsets[-1], 3))
        labels = language.viterbi(scores, offsets)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if a == b:
                continue
            best = scores[a]
            for t in range(a + 1, b):
                best = np.maximum(best, best.max() - language.PENALTY) + scores[t]
            own = labels[a:b]
            value = scores[np.arange(a, b), own].sum() - language.PENALTY * (own[1:] != own[:-1]).sum()
            assert value == pytest.approx(best.max())


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in held} == {2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_scripts_and_spans(spark, make_docs):
    texts = ["the cat sat on the mat and was happy there all day"] * 12 + ["кошка сидела на ковре и была очень довольна"] * 12
    docs = spark.createDataFrame([(i, t, "en" if i < 12 else "ru") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    mixed = "the cat was happy кошка сидела на ковре очень довольна the mat and the cat"
    row = language.identify(make_docs([mixed]), model).first()
    raw = mixed.encode()
    assert [(s.lang, raw[s.begin : s.end].decode()) for s in row.spans] == [
        ("en", "the cat was happy"),
        ("ru", "кошка сидела на ковре очень довольна"),
        ("en", "the mat and the cat"),
    ]
    assert row.lang_pred == "ru" and 0.5 < row.score < 1


def test_language_edges(spark, make_docs, odd):
    docs = make_docs([*odd, (None, "no id")], extra=True)
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert [rows[i].lang_pred for i in range(5)] == ["und"] * 4 + ["en"]
    assert rows[0].score == 0 and rows[None].held_out is False
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.text.substr(1, 0)).filter("false").unionByName(docs.selectExpr("*").limit(0))).collect()} == set()
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
