"""Registered queries against their SQL on the smallest tables.

The default run covers one query per operator family; ``LANESPAN_ALL=1`` runs every query.
"""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

DATA = Path(os.environ.get("LANESPAN_DATA", "/root/testdata/sf0.001"))
FAMILIES = (
    "split_audit calibration_sample pair_images provenance_status artifact_normalize every_n_frames legacy_cleanup "
    "label_components zone_shares branch_connectors evaluation_report backend_parity stage_summary ema suppress_duplicates "
    "ema_stream ema_runs_stream valid_group track_branches choose_main dataset_merkle dataset_diff provenance_chains chain_status label_tiles"
).split()
NAMES = sorted(contract.queries()) if os.environ.get("LANESPAN_ALL") else FAMILIES


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    number = float(value)
    return None if math.isnan(number) else round(number, 6) + 0.0


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, engine, name):
    df = contract.queries()[name](spark, str(DATA))
    found = table(df.columns, df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert found[1]
        return
    result = engine.execute(sql)
    assert found == table([d[0] for d in result.description], result.fetchall())


def test_catalogue_is_consistent():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
def test_entry_has_a_row(spark):
    assert contract.entry(spark).count() == 1
