"""The stored index against the entries it was made from, and places in a total order."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from fathomtext.operators import postings, themes
from fathomtext.operators.order import bounds, placed, range_of
from fathomtext.plans import vocabulary as V

SCHEMA = "tag string, ticker string, company string, sector string, role string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(6)
    tags = [*list(V.THEMES)[:8], "碳化矽", "a/b", "rare", ""]
    rows = []
    for i in range(300):
        for t in {"HBM", *rng.sample(tags, rng.randrange(5))} if i % 3 else rng.sample(tags, rng.randrange(3)):
            rows.append((t, str(1000 + i), f"c{i}" if i % 7 else None, f"s{i % 5}", rng.choice(postings.ROLES)))
    folder = f"file://{tmp_path_factory.mktemp('index')}/i"
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    old = postings.SPAN
    postings.SPAN = 64  # several stretches
    assert postings.build(frame.where("false"), folder) == 1 and postings.screen(spark, folder).count() == 0 and postings.build(frame, folder) == 2
    yield folder, rows
    postings.SPAN = old


def test_screens_and_counts(spark, index):
    folder, rows = index
    assert collections.Counter(tuple(r) for r in postings.screen(spark, folder).collect()) == collections.Counter(rows)
    some = ["HBM", "碳化矽", "nowhere"]
    assert collections.Counter(tuple(r) for r in postings.screen(spark, folder, some).collect()) == collections.Counter(r for r in rows if r[0] in some)
    counts = {r["tag"]: (r["companies"], *(r[x] for x in postings.ROLES)) for r in postings.term_counts(spark, folder).collect()}
    by_role = collections.Counter((r[0], r[4]) for r in rows)
    assert counts == {t: (sum(r[0] == t for r in rows), *(by_role[t, x] for x in postings.ROLES)) for t in {r[0] for r in rows}}
    stored = postings.part(spark, folder, "postings").where("tag = 'HBM'").collect()
    assert len(stored) > 2 and all(list(r["at"]) == sorted(set(r["at"])) and r["n"] == len(r["at"]) for r in stored)


def test_neighbours_and_pairs(spark, index):
    folder, rows = index
    docs = collections.defaultdict(set)
    for r in rows:
        docs[r[1]].add(r[0])
    want = collections.Counter(t for ts in docs.values() if "rare" in ts for t in ts if t != "rare")
    assert {r["neighbor"]: r["weight"] for r in postings.neighbors(spark, folder, "rare").collect()} == want
    assert {r["ticker"] for r in postings.both(spark, folder, "HBM", "rare").collect()} == {d for d, ts in docs.items() if {"HBM", "rare"} <= ts}


def test_a_screen_moves_no_reports_and_opens_few_files(spark, index):
    folder, _ = index
    scan = postings.postings_of(spark, folder, ["HBM"])
    plan = plan_of(scan)
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and str(postings.bucket("HBM")) in filters and "EqualTo(tag,HBM)" in plan
    assert "Exchange" not in plan_of(postings.numbers(scan))  # spelled out where they are read
    screened = plan_of(postings.screen(spark, folder, ["HBM"]))
    assert "content" not in screened and "SortMergeJoin" not in screened and "Exchange hashpartitioning" not in screened
    related = plan_of(themes.related(themes.theme_table(spark), postings.term_counts(spark, folder).select("tag", F.col("companies").alias("cnt"))))
    assert "content" not in related


def test_places_do_not_gather_common_prefixes(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), f"11{i:05d}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "role string, ticker string").repartition(5)
    got = sorted((r["place"], r["role"], r["ticker"]) for r in placed(frame, "role", "ticker").collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert got == [(i + 1, *r) for i, r in enumerate(order)]
    cuts = bounds(frame, ("role", "ticker"))
    sizes = [r["count"] for r in frame.groupBy(range_of(frame, ("role", "ticker"), cuts).alias("r")).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 4 * 3000 / 64
    assert placed(frame.limit(0), "role", "ticker").count() == 0
    assert [r["place"] for r in placed(frame.limit(1), "role", "ticker").collect()] == [1]
    same = placed(spark.createDataFrame([("x",)] * 10, "k string"), "k")
    assert sorted(r["place"] for r in same.collect()) == list(range(1, 11))


def test_rows_read_several_times_are_made_once(spark, tmp_path, monkeypatch):
    """Names are grouped and reports numbered once: what placed() reads three times and the join that two tables need are stored."""
    seen, plain = [], postings.placed
    monkeypatch.setattr(postings, "placed", lambda rows, *a, **k: seen.append(rows) or plain(rows, *a, **k))
    rows = [("HBM", "1", "a", "s", "related"), ("5G", "1", "a", "s", "related"), ("HBM", "2", "b", "s", "related")]
    postings.build(spark.createDataFrame(rows, "tag string, ticker string, company string, sector string, role string"), str(tmp_path / "index"))
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in postings.neighbors(spark, str(tmp_path / "index"), "HBM").collect()} == {("5G", 1)}
