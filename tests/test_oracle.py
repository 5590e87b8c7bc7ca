"""Every SQL-checkable query equals its DuckDB oracle (sf0.001, fast)."""

import pytest

from conftest import SF_SMALL
from tastemap.plans.catalogue import QUERIES
from tastemap.plans.oracle import ORACLE
from tools.oracle_check import TABLES, digest

NAMES = sorted(set(ORACLE) - {"stream_recommend", "recs_append"})


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(ORACLE[name])
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(rel.columns, drows)[0]
