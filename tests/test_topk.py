"""Top names over days that are added and replaced."""

import collections
import random

import pytest

from fathomtext.operators import topk


def frame(spark, rows):
    return spark.createDataFrame(rows, "day string, name string").repartition(3)


def best(rows, k):
    count = collections.Counter(n for d, n in rows if d is not None and n is not None)
    return sorted(((n, c) for n, c in count.items()), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("tracked, exact", [(1024, True), (24, False)])
def test_days_add_up(spark, tmp_path, tracked, exact):
    rng, folder = random.Random(1), f"file://{tmp_path}/t"
    day = lambda d, n: [(d, f"n{int(rng.paretovariate(0.7)) % 3000}") for _ in range(n)]
    rows = day("2024-01-01", 4000) + day("2024-01-02", 3000) + [(None, "n1"), ("2024-01-01", None)]
    topk.add(frame(spark, rows), folder, tracked)
    got, enough = topk.top(spark, folder, 10, tracked)
    assert [tuple(r) for r in got.collect()] == best(rows, 10)
    more, again = day("2024-01-03", 2000), day("2024-01-02", 500)
    topk.add(frame(spark, more), folder, tracked)
    topk.add(frame(spark, again), folder, tracked)  # the day comes again and replaces what was there
    rows = [r for r in rows if r[0] != "2024-01-02"] + more + again
    got, enough = topk.top(spark, folder, 10, tracked)
    assert [tuple(r) for r in got.collect()] == best(rows, 10)
    assert enough == exact  # a sketch that is too small is noticed, and all counts are added up


def test_what_a_sketch_lacks_is_rarer_than_the_error(spark, tmp_path):
    rng, folder = random.Random(2), f"file://{tmp_path}/t"
    rows = [(f"d{k % 5}", f"n{int(rng.paretovariate(0.6)) % 5000}") for k in range(20_000)]
    topk.add(frame(spark, rows), folder, 96)
    held, n = topk.merged(spark, folder, 96)
    held = {r["name"] for r in held.collect()}
    count = collections.Counter(n for _, n in rows)
    assert n == len(rows) and max(c for x, c in count.items() if x not in held) <= topk.error(n, 96)


def test_candidates_alone_are_counted(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    topk.add(frame(spark, [("d", "a")] * 500 + [("d", "b")] * 400 + [("e", "a")] * 10 + [("e", f"x{k}") for k in range(50)]), folder, 12)
    found, enough = topk.top(spark, folder, 2, 12)
    assert enough and [tuple(r) for r in found.collect()] == [("a", 510), ("b", 400)]
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
    topk.add(frame(spark, []), folder)
    assert topk.top(spark, folder, 2, 12)[0].count() == 2
    topk.add(frame(spark, []), f"{folder}/none")
    assert topk.top(spark, f"{folder}/none", 2)[0].count() == 0
