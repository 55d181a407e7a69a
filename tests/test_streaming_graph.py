"""The graph kept over a stream of inserts, replacements and withdrawals equals the batch graph over the newest reports."""

import random

import pytest

from fathomtext.operators import mentions, network
from fathomtext.streaming import graph, mention_counts, stream_mentions


def report(names):
    return f"# x\n\n## 業務簡介\n{' '.join(f'[[{n}]]' for n in names)}\n\n## 財務概況\n[[not counted]]"


@pytest.fixture()
def stream(spark, tmp_path):
    source, schema = tmp_path / "in", "ticker string, version long, content string"
    source.mkdir()

    class Stream:
        folder, newest, files = f"file://{tmp_path}/graph", {}, 0

        def put(self, rows):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
            for ticker, version, content in rows:
                if ticker is not None and version is not None and version >= self.newest.get(ticker, (version, ""))[0]:
                    self.newest[ticker] = (version, content)

        def run(self):
            rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
            query = graph.stream_edges(rows, self.folder, f"file://{tmp_path}/checkpoint", once=True)
            query.awaitTermination()

        def agrees(self, least):
            now = spark.createDataFrame([(t, c) for t, (_, c) in self.newest.items() if c is not None], "ticker string, content string")
            want = {tuple(r) for r in network.edges(mentions.report_mentions(now), "ticker", min_weight=least).collect()}
            return want == {tuple(r) for r in graph.edges(spark, self.folder, least).collect()}

    return Stream()


def test_inserts_replacements_and_withdrawals(spark, stream):
    rng = random.Random(4)
    some = lambda: report(rng.sample([f"n{i}" for i in range(25)], rng.randrange(12)))
    stream.put([(str(1000 + i), 1, some()) for i in range(60)] + [(None, 1, some()), ("1", None, some())])
    stream.run()
    assert stream.agrees(2) and stream.agrees(5)
    stream.put([(str(1000 + i), 2, some()) for i in range(0, 60, 3)] + [("1001", 2, None), ("2000", 1, some())])
    stream.put([("1004", 3, some()), ("1004", 5, some()), ("1003", 1, some())])  # several versions at once; an old one that is late
    stream.run()
    assert stream.agrees(2) and stream.agrees(1)
    graph.compact(spark, stream.folder)
    assert stream.agrees(2)
    stream.put([("1001", 3, some()), ("1004", 6, None)])
    stream.run()
    assert stream.agrees(2)
    graph.compact(spark, stream.folder)
    graph.compact(spark, stream.folder)
    assert stream.agrees(1)


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([("d", "a", 1), ("d", "b", 0), ("d", "c", -1), ("d", "e", -1), ("f", "a", 1), ("f", "b", 1)], graph.CHANGES)
    assert {tuple(r) for r in graph.pair_changes(rows).collect()} == {("a", "b", 2), ("b", "c", -1), ("b", "e", -1), ("c", "e", -1)}
    for _ in range(2):
        graph.pair_changes(rows).write.mode("overwrite").parquet(f"file://{tmp_path}/g/changes/batch=0")
    assert {tuple(r) for r in graph.edges(spark, f"file://{tmp_path}/g", 1).collect()} == {("a", "b", 2)}


def test_mention_counts_over_a_stream(spark, tmp_path):
    schema = "content string"
    (tmp_path / "in").mkdir()
    for k, texts in enumerate([["[[a]] [[b]] [[a]]", None], ["[[b]]", "no link", "[[c]] [[a]]"]]):
        spark.createDataFrame([(t,) for t in texts], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        stream_mentions(stream, f"file://{tmp_path}/counts", f"file://{tmp_path}/checkpoint", once=True).awaitTermination()
        want = {"a": 2, "b": 1} if k == 0 else {"a": 3, "b": 2, "c": 1}
        assert {r["name"]: r["cnt"] for r in mention_counts(spark, f"file://{tmp_path}/counts").collect()} == want
