"""Every core query against its SQL in DuckDB, and the plans' shape."""

import pytest
from support import same_rows
from tallyweave import queries as core

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same_rows(core.queries()[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("shift", [2**23 - 10, 2**24 - 10, 2**40])
def test_wrapping_join_of_large_keys(spark, sf_dir, tmp_path, shift):
    """Order keys whose shifted values reach bit 63, pass 2^64 and lose all but their low bits, and half the suppliers only."""
    import duckdb

    con = duckdb.connect()
    for table, _ in core.TABLES:
        source, path = f"read_parquet('{sf_dir}/{table}.parquet')", tmp_path / f"{table}.parquet"
        rows = {"lineitem": f"SELECT * REPLACE (l_orderkey + {shift} AS l_orderkey) FROM {source}", "supplier": f"SELECT * FROM {source} WHERE s_suppkey % 2 = 0"}
        con.execute(f"COPY ({rows.get(table, f'SELECT * FROM {source}')}) TO '{path}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    out = core.queries()["wrapping_join"](spark, str(tmp_path))
    same_rows(out, con, SQL["wrapping_join"])
    assert "keys=[b0_c1" in plan_of(out).split("== Physical Plan ==")[1]  # summed up before the join


def test_approximate_distinct_counts(spark, sf_dir):
    exact = {(r.relation, r.column_no): r for r in core.queries()["column_stats"](spark, sf_dir).collect()}
    for r in core.queries()["column_stats_approx"](spark, sf_dir).collect():
        want = exact[r.relation, r.column_no]
        assert (r.n_rows, r.low, r.high) == (want.n_rows, want.low, want.high)
        assert abs(r.n_distinct - want.n_distinct) <= max(2, 0.2 * want.n_distinct)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    plan = plan_of(core.planner(spark, sf_dir).plan("6 5|0.0=1.0&0.3=1|0.1 1.1"))
    assert "l_suppkey" not in plan.split("== Physical Plan ==")[1]
    assert "EqualTo(l_linenumber,1)" in plan


def test_equal_columns_share_a_sum(spark, sf_dir):
    plan = plan_of(core.planner(spark, sf_dir).plan(core.TEXTS["sum_equivalence"])).split("== Physical Plan ==")[1]
    assert plan.count("partial_sum") == 2


def test_no_python_in_plans(spark, sf_dir):
    for text in core.TEXTS.values():
        assert "Python" not in plan_of(core.planner(spark, sf_dir).plan(text))


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["s0", "s1", "s2", "s3"] and out.count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
