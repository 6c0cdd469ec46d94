"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""

import pytest

from paths import SF_SMALL


def _keys():
    from martlet.suite import ORACLE
    return sorted(ORACLE)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    from martlet.session import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", _keys())
def test_matches_oracle(spark, duck, key):
    from martlet.suite import ORACLE, QUERIES
    from tools.oracle_check import rows_of
    sdf = QUERIES[key](spark, SF_SMALL)
    s_cols, s_rows = sdf.columns, [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLE[key])
    d_cols, d_rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_rows_only_keys_run(spark):
    from martlet.suite import ORACLE, QUERIES
    for key in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[key](spark, SF_SMALL).count() > 0
