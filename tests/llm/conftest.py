from collections.abc import Iterable

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    def build(texts: Iterable, extra: bool = False):
        """Documents from texts or (doc_id, text) pairs; ``extra`` adds columns whose names clash with results."""
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "src", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            for name in ("score", "size", "key", "kept", "digest", "words", "text_key", "fp", "pos", "h", "rank", "shard", "gone", "who"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


#: Texts that every operator has to stand: null, empty, blank, no letters, characters of several lengths, repeats, one very long.
ODD = [
    None,
    "",
    "   \n\t ",
    "12 345 !!",
    "é",
    "日本語のテキスト 😀 and English",
    "the same text twice over and over again here",
    "the same text twice over and over again here",
    "word " * 60_000,
    "x" * 50_000,
    "a<|endoftext|>b",
]


@pytest.fixture
def odd():
    return list(ODD)
