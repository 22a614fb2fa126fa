"""Every registered query against its oracle SQL (DuckDB) on sf0.001 —
the driver's correctness gate, run locally on the smallest scale."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as E
from crmlake.plans import registry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
from oracle_check import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "win_rate" in df.columns


def test_every_query_has_an_oracle():
    assert set(registry.oracles()) == set(registry.callables())
    assert set(registry.callables()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(registry.callables()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    d_cols, d_rows = [c[0] for c in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(s_cols, s_rows)[0] == digest(d_cols, d_rows)[0]
