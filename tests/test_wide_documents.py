"""Pairs of the names of documents with very many names."""

import collections
import itertools
import random

from pyspark.sql import functions as F

from fathomtext.operators import network


def test_pairs_of_blocks_agree_with_brute_force(spark):
    rng = random.Random(1)
    rows = [("wide", f"n{i}") for i in range(150)] + [(f"d{k}", f"n{rng.randrange(200)}") for k in range(40) for _ in range(rng.choice([0, 1, 2, 9, 40]))]
    rows += rows[:50] + [(None, "n1"), ("d1", None)]
    frame = spark.createDataFrame(rows, "doc string, name string")
    once = {(d, n) for d, n in rows if d is not None and n is not None}
    by_doc = collections.defaultdict(set)
    for d, n in once:
        by_doc[d].add(n)
    want = collections.Counter((d, *p) for d, ns in by_doc.items() for p in itertools.combinations(sorted(ns), 2))
    for size in (1, 4, 16, 1000):
        got = collections.Counter(tuple(r) for r in network.pairs(frame.dropna().distinct(), "doc", size).collect())
        assert got == want
    df = collections.Counter(n for _, n in once)
    weight = collections.Counter((a, b) for _, a, b in want if df[a] >= 2 and df[b] >= 2)
    edges = {tuple(r) for r in network.edges(frame, "doc", min_weight=2, size=8).collect()}
    assert edges == {(*p, n) for p, n in weight.items() if n >= 2}


def test_a_very_wide_document_is_spread_over_tasks(spark):
    once = spark.range(20_000).select(F.lit("d").alias("doc"), F.concat(F.lit("n"), "id").alias("name")).unionByName(spark.createDataFrame([("e", "x"), ("e", "y")], "doc string, name string"))
    left, right = network.blocks(once, "doc")
    k = -(-20_000 // network.BLOCK)
    for side in (left, right):
        sizes = side.groupBy("doc", "a", "b").count()
        most, keys = sizes.agg(F.max("count"), F.count(F.lit(1))).first()
        assert most < 2 * network.BLOCK and keys == k * (k + 1) // 2 + 1
    # the join of two blocks goes by document and blocks, so no task has to take a document
    plan = network.pairs(once, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Join [doc#" in plan and ", a#" in plan and ", b#" in plan
    keys = left.join(right.select("doc", "a", "b").distinct(), ["doc", "a", "b"], "left_semi").select(F.pmod(F.hash("doc", "a", "b"), F.lit(200)).alias("task"))
    assert keys.distinct().count() == 200


def test_pairs_are_not_broadcast(spark):
    rows = spark.createDataFrame([(d, n) for d in range(6) for n in "abc"], "d int, name string")
    pairs = network.pairs(rows, "d")
    made = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in made
    assert pairs.count() == 18
