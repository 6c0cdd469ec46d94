"""Hot keys: a copy of the smallest tables in which one key holds a third of
the rows (one order, part and supplier in `lineitem`, one customer in
`orders`, one text copied into a third of `documents`). The join- and
aggregate-heavy queries must still agree with their DuckDB oracles; their
plans combine the hot key map-side (partial aggregation) before shuffling."""

import os

import pytest

from paths import SF_SMALL

HOT_KEYS = [
    "q_top_products", "q_return_rate_by_region", "q_return_anomaly_by_region", "q_aov_by_part_type",
    "q_top_customers", "q_segment_revenue_aov", "q_aov_by_segment", "q_overrepresentation",
    "q_rollup_month_region", "q_star_wide", "q_order_value_outliers", "check_unique_lineitem",
    "check_fk_orders", "rollup_orders", "price_lines", "value_distribution", "warehouse_profile",
    "slug_keys", "question_table_rank", "clean_drop_duplicates", "profile_orders", "result_match",
    "return_rate_rule", "distribution_by_flag", "check_unique_custkey", "sink_append_once", "foreign_key_candidates",
    "clean_drop_wide_duplicates", "coerce_census_dates", "profile_store_update",
]


@pytest.fixture(scope="module")
def skew_dir(tmp_path_factory):
    import duckdb
    from martlet.session import TABLES
    out = str(tmp_path_factory.mktemp("skew"))
    con = duckdb.connect()
    src = {t: f"read_parquet('{SF_SMALL}/{t}.parquet')" for t in TABLES}
    hot = {
        "lineitem": f"""SELECT CASE WHEN hot THEN (SELECT min(l_orderkey) FROM {src['lineitem']}) ELSE l_orderkey END
                               AS l_orderkey,
                           CASE WHEN hot THEN (SELECT min(l_partkey) FROM {src['lineitem']}) ELSE l_partkey END
                               AS l_partkey,
                           CASE WHEN hot THEN (SELECT min(l_suppkey) FROM {src['lineitem']}) ELSE l_suppkey END
                               AS l_suppkey,
                           * EXCLUDE (l_orderkey, l_partkey, l_suppkey, hot)
                    FROM (SELECT *, hash(l_orderkey, l_linenumber) % 3 = 0 AS hot FROM {src['lineitem']})""",
        "orders": f"""SELECT o_orderkey,
                         CASE WHEN o_orderkey % 3 = 0 THEN (SELECT min(o_custkey) FROM {src['orders']})
                              ELSE o_custkey END AS o_custkey,
                         * EXCLUDE (o_orderkey, o_custkey) FROM {src['orders']}""",
        "documents": f"""SELECT doc_id,
                            CASE WHEN doc_id % 3 = 0 THEN (SELECT text FROM {src['documents']}
                                                           ORDER BY doc_id LIMIT 1) ELSE text END AS text,
                            * EXCLUDE (doc_id, text) FROM {src['documents']}""",
    }
    for t in TABLES:
        query = hot.get(t, f"SELECT * FROM {src[t]}")
        con.execute(f"COPY ({query}) TO '{os.path.join(out, t + '.parquet')}' (FORMAT parquet)")
    return out


@pytest.fixture(scope="module")
def skew_duck(skew_dir):
    import duckdb
    from martlet.session import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skew_dir}/{t}.parquet')")
    return con


def test_fixture_is_skewed(skew_duck):
    for table, key in (("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("orders", "o_custkey"),
                       ("documents", "text")):
        share = skew_duck.execute(
            f"SELECT max(c) * 1.0 / sum(c) FROM (SELECT count(*) AS c FROM {table} GROUP BY {key})").fetchone()[0]
        assert share > 0.25, (table, key, share)


@pytest.mark.parametrize("key", HOT_KEYS)
def test_hot_key_matches_oracle(spark, skew_dir, skew_duck, key):
    from martlet.suite import ORACLE, QUERIES
    from tools.oracle_check import rows_of
    sdf = QUERIES[key](spark, skew_dir)
    s_cols, s_rows = sdf.columns, [tuple(r) for r in sdf.collect()]
    cur = skew_duck.execute(ORACLE[key])
    d_cols, d_rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_hot_order_key_combined_before_shuffle(spark, skew_dir):
    from martlet.suite import QUERIES
    p = QUERIES["q_return_rate_by_region"](spark, skew_dir)._jdf.queryExecution().executedPlan().toString()
    first_exchange = p.rfind("Exchange hashpartitioning(l_orderkey")
    assert first_exchange > 0 and "partial_count" in p[first_exchange:]
