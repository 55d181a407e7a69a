"""Costly parts of a text are taken once a text, however often the rules use them."""

from pyspark.sql import functions as F

from fathomtext.functions import text as X
from fathomtext.operators import audit
from fathomtext.plans import queries
from fathomtext.streaming import graph


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_snippets_split_a_text_once(spark):
    rows = spark.createDataFrame([("a KW b [[KW]] c KW",)], "t string")
    assert plan(rows.select(X.snippets(F.col("t"), "KW").alias("s"))).count("split(t#") == 1


def test_audit_takes_lines_and_links_once(spark):
    reports = spark.createDataFrame([("1", "x" * 300 + " [[a]]")], "ticker string, content string")
    batches = spark.createDataFrame([(1, ["1", "2"])], "batch int, tickers array<string>")
    found = audit.audit(batches, reports)
    text = plan(found.select("batch", "ticker", F.posexplode("issues").alias("ord", "issue")))
    assert text.count("split(content#") == 1 and text.count("regexp_extract_all(content#") == 1
    assert found.select(F.explode("issues").alias("i")).where("i like 'Only %'").count() == 1


def test_pairs_of_a_micro_batch_do_not_run_the_stateful_operator_again(spark, tmp_path, monkeypatch):
    seen, made = [], graph.pair_changes
    monkeypatch.setattr(graph, "pair_changes", lambda rows: seen.append(rows._jdf.queryExecution().analyzed().toString()) or made(rows))
    text = "[[a]] [[b]]"
    spark.createDataFrame([(str(i), 1, text) for i in range(5)], "ticker string, version long, content string").write.parquet(f"file://{tmp_path}/in")
    rows = spark.readStream.schema("ticker string, version long, content string").parquet(f"file://{tmp_path}/in")
    graph.stream_edges(rows, f"file://{tmp_path}/graph", f"file://{tmp_path}/checkpoint", once=True).awaitTermination()
    assert len(seen) == 1 and "parquet" in seen[0] and "Transform" not in seen[0] and "MapPartitions" not in seen[0]
    assert [tuple(r) for r in graph.edges(spark, f"file://{tmp_path}/graph", 5).collect()] == [("a", "b", 5)]
    assert not (tmp_path / "graph" / "names" / "batch=0").exists()


def test_entries_of_other_tags_go_before_companies_are_counted(spark):
    lines = plan(queries.QUERIES["theme_related_counts"](spark, "/root/testdata/sf0.001")).splitlines()
    semi = [i for i, x in enumerate(lines) if "Join LeftSemi" in x]
    counted = [i for i, x in enumerate(lines) if "Aggregate [tag" in x and "ticker" in x]
    assert semi and counted and max(counted) < semi[0]
