"""Filter audit against plain loops over documents and orders."""

from collections import Counter
from itertools import permutations

from lanespan.llm import filter_audit

LABELS = "doc_id bigint, quality int, toxic int"
NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(doc_id, text, texts):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    same = [i for i, t in texts if (t or "") == text and i is not None and (doc_id is None or i < doc_id)]
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": bool(same),
    }


def plain(docs, labels):
    """Rows of the audit; ``docs`` are (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    texts = [(i, t) for i, t, _ in docs]
    judged = [(i, lang or "", fails(i, t, texts)) for i, t, lang in docs]
    out, shares = {}, Counter()
    for part in {p for _, p, _ in judged}:
        own = [(i, f) for i, p, f in judged if p == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                gone = [any(f[y] for y in order[:k]) for _, f in own]
                removed = [i for (i, f), g in zip(own, gone, strict=True) if f[x] and not g]
                shares[part, x] += len(removed)
                out[part, "".join(order), k + 1] = [
                    sum(not g and not f[x] for (_, f), g in zip(own, gone, strict=True)),
                    len(removed),
                    sum(g and f[x] for (_, f), g in zip(own, gone, strict=True)),
                    sum(f[x] and sum(f.values()) == 1 for _, f in own),
                    sum(i in good for i in removed),
                    sum(i in toxic for i in removed),
                ]
    return sorted((p, o, k, *v, shares[p, o[k - 1]]) for (p, o, k), v in out.items())


def check(spark, docs, labels, extra=False):
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(3)
    if extra:
        for name in ("mask", "n", "copies", "digest", "part", "step", "first"):
            df = df.selectExpr("*", f"'x' AS {name}")
    audited = filter_audit.audit(df, spark.createDataFrame(labels, LABELS))
    assert audited.columns == list(NAMES)
    rows = sorted(tuple(r) for r in audited.collect())
    assert rows == plain(docs, labels)
    return rows


def words(n, distinct=None):
    return " ".join(f"w{k % (distinct or n)}" for k in range(n))


def test_limits(spark):
    texts = [words(99), words(100), words(101), words(100, 80), words(100, 79), "A" * 10 + "b" * 90, "A" * 11 + "b" * 89, "50 %", "a|b\x0bc", words(120) + "É" * 200, words(150, 3) + " #" + "X" * 300]
    docs = [(i, t, ["en", "de"][i % 2]) for i, t in enumerate(texts)]
    check(spark, docs, [(i, i % 2, int(i % 3 == 0)) for i in range(0, len(texts), 2)])


def test_copies_nulls_and_repeats(spark):
    docs = [(3, "same", "en"), (1, "same", "de"), (2, "same", None), (2, "same", ""), (4, None, None), (5, "", "en"), (None, "same", "en"), (None, "alone", "en"), (None, "alone", "en"), (6, " \t", "en")]
    labels = [(1, 1, 1), (2, 1, 0), (2, 0, None), (3, None, 1), (None, 1, 1)]
    rows = check(spark, docs, labels, extra=True)
    assert {r[0] for r in rows} == {"", "de", "en"} and len(rows) == 1800


def test_hot_text(spark):
    docs = [(i, "copy " * 120 if i % 3 else f"text {i}", "en") for i in range(3000)]
    rows = {r[1:3]: r for r in (tuple(x) for x in filter_audit.audit(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame([], LABELS)).collect())}
    assert rows["ECDBA", 1][4] == 1999 and rows["ECDBA", 1][3] == 1001


def test_empty(spark):
    assert filter_audit.audit(spark.createDataFrame([], "doc_id bigint, text string, lang string"), spark.createDataFrame([], LABELS)).collect() == []
