"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from fathomtext.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("None" if x is None or x != x else str(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    want = con.sql(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data")
def test_hot_plans_stay_in_the_jvm(spark):
    for name in ("network_edges_basket", "discover_contexts", "audit_issues", "stmt_metrics"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data")
def test_scans_read_only_what_is_used(spark):
    plan = Q.QUERIES["discover_sector_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(source" in plan.split("PushedFilters")[1] and "n_chars" not in plan
