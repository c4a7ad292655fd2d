"""Registered queries on the smallest tables: columns of the contract, whole tables, and SQL where there is any."""

import duckdb
import pytest

from lanespan.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3_sequences": "doc_id start n_tokens ids_crc32",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_language": "doc_id held_out lang_pred score",
    "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_quality": "doc_id held_out score predicted",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op12_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op13_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}
#: What makes a row, where it is not one document, and how many rows there are.
KEYS = {
    "op11_vector_codes": (1, "SELECT count(*) FROM embeddings"),
    "op12_packing": (2, None),
    "op13_filter_audit": (3, "SELECT 600 * count(DISTINCT coalesce(lang, '')) FROM documents"),
}


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_all_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS) and set(queries.ORACLES) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, engine, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.columns == COLUMNS[name].split()
    rows = [tuple(r) for r in df.collect()]
    width, total = KEYS.get(name, (1, "SELECT count(*) FROM documents"))
    assert len({r[:width] for r in rows}) == len(rows)
    assert total is None or len(rows) == engine.execute(total).fetchone()[0]
    if name in queries.ORACLES:
        result = engine.execute(queries.ORACLES[name])
        names = [d[0] for d in result.description]
        order = [names.index(c) for c in df.columns]
        assert sorted(rows) == sorted(tuple(r[i] for i in order) for r in result.fetchall())
