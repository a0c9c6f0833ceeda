"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison at sf0.01)."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as ent
from tools.check_oracle import TABLES, digest

QUERIES = ent.queries()
ORACLES = ent.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    if key not in ORACLES:
        assert df.columns  # rows-only check
        return
    cur = duck.execute(ORACLES[key])
    ocols = [d[0] for d in cur.description]
    exp = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(exp)
    assert digest(df.columns, got)[0] == digest(ocols, exp)[0]


def test_entry_smoke(spark):
    df = ent.entry(spark)
    assert df.count() > 0 and "aov" in df.columns
