"""Dominance counts, clusters and mixes against brute force, on rows with nulls, ties, repeats and clashing names."""

import collections
import datetime
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomtext.llm import centroids, dominance, mixing

SF = "/root/testdata/sf0.001"


def brute_counts(points):
    known = [(s, v, w) for s, v, w in points if s is not None and v is not None]
    for s, v, w in points:
        if s is None or v is None:
            yield s, v, w, None, None
        else:
            over = [1 if x is None else x for a, b, x in known if a < s and b > v]
            yield s, v, w, len(over), sum(over)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_corner_sums(n):
    rng = np.random.default_rng(n)
    y, w = rng.permutation(n), rng.integers(0, 9, (n, 2))
    want = np.array([w[:k][y[:k] < y[k]].sum(axis=0) for k in range(n)]).reshape(n, 2)
    assert n == 0 or (dominance.corner_sums(y, w) == want).all()


@pytest.mark.parametrize("least", [4, 64, 1 << 16])
def test_dominance(spark, least, monkeypatch):
    monkeypatch.setattr(dominance.above, "__defaults__", (least, dominance.ROOTS))
    rng = random.Random(least)
    points = [(rng.randrange(40), rng.randrange(-20, 60), rng.choice([None, 1, 2, 5])) for _ in range(900)]
    points += [(7, 7, 3)] * 400 + [(7, k, 1) for k in range(150)] + [(k, 9, 1) for k in range(150)] + [(None, 5, 1)] * 90 + [(5, None, 1), (None, None, None), (-3, 2**53, 1), (2**40, -(2**53), 1)]
    rows = [(*p, "x", "y") for p in points]
    got = dominance.dominance_counts(spark.createDataFrame(rows, "slot long, level long, weight long, n_sales string, strip string").repartition(5), weight="weight")
    assert got.columns == ["slot", "level", "weight", "strip", "n_sales", "n_rows"]
    assert collections.Counter(tuple(r) for r in got.drop("strip").collect()) == collections.Counter(brute_counts(points))


def test_dominance_of_no_and_plain_points(spark):
    empty = spark.createDataFrame([], "slot long, level long")
    assert dominance.dominance_counts(empty).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "slot int, level int")
    assert sorted(tuple(r) for r in dominance.dominance_counts(one).collect()) == [(1, 1, 0, 0), (2, 0, 1, 1), (2, 1, 0, 0)]


def test_sale_points(spark):
    at = datetime.datetime(2024, 3, 10, 2, 30, 59, 999999)  # an hour that New York skips
    rows = [(123, at, 1.005), (0, datetime.datetime(1969, 12, 31, 23, 59, 30), -0.004), (None, at, 2.5), (5, None, float("nan")), (6, at, None), (7, at, 1e300)]
    frame = spark.createDataFrame(rows, "sale_id long, sold_at timestamp_ntz, total double")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = {r["sale_id"]: tuple(r)[1:] for r in dominance.sale_points(frame).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    slot = (at - datetime.datetime(1970, 1, 1)) // datetime.timedelta(minutes=1)
    weight = lambda i: 1 + zlib.crc32(str(i).encode()) % 5
    assert got == {123: (slot, math.floor(100 * 1.005 + 0.5), weight(123)), 0: (-1, 0, weight(0)), None: (slot, 250, 1), 5: (None, None, weight(5)), 6: (slot, None, weight(6)), 7: (slot, None, weight(7))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data")
@pytest.mark.parametrize("query, sql, name", [(dominance.op11_dominance, dominance.OP11_SQL, "sales"), (centroids.op12_centroids, centroids.OP12_SQL, "embeddings")])
def test_query_agrees_with_sql(spark, query, sql, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    got, want = query(spark, SF).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: collections.Counter(tuple("-" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def brute_clusters(rows, k, rounds, seed):
    v = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == 3 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), e) for i, e in v if i is not None)
    at = [e for _, e in order[:k]]
    for r in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), j) for j, c in enumerate(at)) for _, e in v]
        if r < rounds:
            for j in range(len(at)):
                own = [e for (_, e), (_, c) in zip(v, found, strict=True) if c == j]
                if own:
                    at[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return collections.Counter((i, c, d) for (i, _), (d, c) in zip(v, found, strict=True)), at


def test_centroids(spark):
    rng = random.Random(3)
    grid = [[rng.choice([-1.0, 0.0, 0.25, 1.0]) for _ in range(3)] for _ in range(40)]  # many ties
    rows = [(i, rng.choice(grid)) for i in range(300)] + [(None, grid[0]), (5, grid[1]), (5, grid[2]), (400, None), (401, [1.0]), (402, [None, 1.0, 1.0]), (403, [float("nan"), 1.0, 1.0]), (404, [float("inf"), 1.0, 1.0]), (405, [])]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, v string, cluster string").repartition(5)
    for k in (1, 4, 16, 500):
        got, at, sums = centroids.cluster(frame, clusters=k, rounds=3, dim=3)
        want, final = brute_clusters(rows, k, 3, 1)
        assert collections.Counter(tuple(r) for r in got.collect()) == want
        assert at.tolist() == final and sum(n for n, _, _ in sums.values()) == sum(want.values())
    assert centroids.cluster(frame.limit(0), dim=3)[0].count() == 0
    assert centroids.cluster(frame.where("vec_id is null"), dim=3)[0].count() == 0


def test_large_components_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e9, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="overflow"):
        centroids.cluster(frame, dim=3)[0].count()


def test_sorted_scan_is_exact():
    rng = np.random.default_rng(2)
    v, at = rng.integers(-4, 5, (500, 4)), rng.integers(-4, 5, (30, 4))
    d = ((v[:, None] - at[None]) ** 2).sum(axis=-1)
    best, least = centroids.nearest(v, rng.integers(0, 30, 500), at)
    assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, stopped = {s: weights[k % len(weights)] for k, s in enumerate(order)}, {}
    while True:
        left, open_ = sum(sizes.values()) - sum(stopped.values()), [s for s in order if s not in stopped]
        if not open_:
            return stopped
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > most * sizes[s]]
        if not over:
            return stopped | {s: weight[s] * share for s in open_}
        stopped |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(1)
    names = ["a", "b", "B", "é", "z" * 50, "", None, "tiny", "empty", "one size"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 40, 200])), rng.choice(names[:7])) for i in range(1500)]
    rows += [(2000, "just three words", "tiny"), (2001, None, "empty"), (2002, "\t\n", "empty"), (None, "no id", "a"), (None, None, None), (2003, "w " * 30_000, "b"), (7, "again 7", "a"), (7, "again 7", "a")]
    rows += [(3000 + i, "five words and no more", "one size") for i in range(2500)]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, source string, size string, s string, place string").repartition(6)
    got = mixing.mix(frame).collect()
    sizes, taken, smallest = collections.Counter(), collections.Counter(), {}
    count = collections.Counter((i, len((t or "").split()), s) for i, t, s in rows)
    for _, t, s in rows:
        n = len((t or "").split())
        sizes[s] += n
        smallest[s] = min(smallest.get(s, n or math.inf), n or math.inf)
    want = brute_targets(dict(sizes))
    assert collections.Counter((r["doc_id"], r["size"], r["source"]) for r in got) == count
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 and abs(r["copies"] - r["rate"]) <= 3
        taken[r["source"]] += r["taken"]
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= max(5, 0.01 * goal), s
    assert want["tiny"] == 9 and taken["tiny"] == 9
    # the same rows in another order and other partitions give the same copies
    again = mixing.mix(frame.repartition(3, "text")).collect()
    plain = lambda rows: collections.Counter((r["doc_id"], r["size"], r["source"], r["taken"]) for r in rows)
    assert plain(got) == plain(again)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_rates_are_the_least_entropy_ones(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(1, 60) for _ in range(200)]
    cells = spark.createDataFrame([("0a", z, n) for z, n in collections.Counter(sizes).items()] + [("0b", 10, 7)], "s string, size long, n long")
    for share in (0.2, 0.9, 1.0, 1.7, 2.9, 2.9999):
        goals = spark.createDataFrame([("0a", sum(sizes), share * sum(sizes)), ("0b", 70, 70.0 * share)], "s string, source_size long, target double")
        found = {r["s"]: r for r in mixing.tilts(cells, goals).collect()}
        t, mean = found["0a"]["t"], found["0a"]["mean"]
        rates = [min(3.0, math.exp(t * z / mean)) for z in sizes]
        assert sum(r * z for r, z in zip(rates, sizes, strict=True)) == pytest.approx(share * sum(sizes), rel=1e-8)
        # stationarity: log rate over size is the same wherever the bound does not hold
        assert len({round(math.log(r) / z, 9) for r, z in zip(rates, sizes, strict=True) if r < 3}) <= 1
        assert math.exp(found["0b"]["t"]) == pytest.approx(share, rel=1e-8)


def test_a_large_cell_is_dealt_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 20)
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2000, "p").otherwise("q").alias("source"))
    got = mixing.mix(frame)
    copies = {r["source"]: (r["c"], r["lo"], r["hi"]) for r in got.groupBy("source").agg(F.sum("copies").alias("c"), F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect()}
    assert sum(c for c, _, _ in copies.values()) == 3000
    assert copies["p"] == (round(3000 * 5 / 7), 1, 2) and copies["q"] == (3000 - round(3000 * 5 / 7), 0, 1)
