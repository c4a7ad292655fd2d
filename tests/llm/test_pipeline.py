"""The pipeline's stages, each held against its operator on its own input."""

import corpus_pipeline

import __spark_entry__ as contract
from lanespan.llm import quality, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, sample_docs):
    docs = sample_docs.selectExpr("*", "'x' AS score", "1 AS kept")
    seen = {"documents": docs.count()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, FOLDER)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs = corpus_pipeline.stored(after, name)
        seen[name] = docs.count()
    assert list(seen) == ["documents", "quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]
    assert seen["documents"] >= seen["quality"] > seen["exact_dedup"] >= seen["near_dedup"] > seen["decontaminate"] == seen["encode"] > 0


def test_result_holds_what_plain_loops_keep(spark, sample_docs):
    from test_dedup import naive_components, naive_fingerprint, near, plain
    from test_filters import naive_report

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality.classify(sample_docs, labels).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in sample_docs.collect() if r.doc_id in good}
    first = {}
    for i in sorted(texts, key=lambda i: (-len(texts[i]), i)):
        first.setdefault(plain(texts[i]), i)
    fps = {i: naive_fingerprint(texts[i]) for i in first.values()}
    root = naive_components(sorted(fps), [(a, b) for a in fps for b in fps if a < b and near(fps[a], fps[b])])
    single = [i for i in fps if root[i] == i]
    clean = {r[0] for r in naive_report([(i, texts[i]) for i in single], items) if not r[-1]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == clean
    assert simhash.LIMIT == 2


def test_empty_table(spark, sample_docs):
    docs = sample_docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
    assert docs.count() == 0


def test_every_operator_is_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names
