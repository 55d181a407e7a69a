"""Tables of more suppliers than four digits tell apart, and reports dealt to tasks."""

import duckdb
import pytest

from fathomtext.plans import queries as Q
from fathomtext.plans import report_queries as R


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("keys")
    keys = "SELECT unnest([1, 7, 12, 999, 1000, 1001, 9999, 10000, 10001, 10002, 10009, 10010, 10012, 99990, 99999, 100000, 100001, 100012]) AS s_suppkey"
    duckdb.sql(f"COPY (SELECT s_suppkey, 'S' AS s_name, CAST(s_suppkey % 25 AS INTEGER) AS s_nationkey, 1.0 AS s_acctbal FROM ({keys})) TO '{path}/supplier.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["base_reports", "report_files", "report_walks", "payload_files"])
def test_suppliers_that_share_a_ticker_are_all_there(spark, folder, name):
    df = Q.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/supplier.parquet'")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"SELECT {columns} FROM ({Q.SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())


def test_reports_are_dealt_to_tasks_and_made_once(spark, tmp_path, monkeypatch):
    duckdb.sql(f"COPY (SELECT i AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, 1 AS p_size FROM range(90) r(i)) TO '{tmp_path}/part.parquet'")
    monkeypatch.setattr(R, "SHARE", 10)
    assert R.part_reports(spark, str(tmp_path)).rdd.getNumPartitions() == 9
    plan = Q.QUERIES["keyword_hits"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan.split("Generate")[0] and "Contains(CASE" not in plan and "HBM" not in plan.split("RepartitionByExpression")[-1]
