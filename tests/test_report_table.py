"""Updates of a report table touch the changed sectors only."""

import random

import pytest

from fathomtext.sources import manifest, report_table
from fathomtext.sources.report_table import COLUMNS, REPORT


def stat(root, spark, folder):
    """sector: names and times of its files."""
    _, state = manifest.read(folder)
    out = {}
    for s, uri in state["parts"].items():
        out[s] = sorted((p.name, p.stat().st_mtime_ns) for p in (root / "t" / "data" / uri.rpartition("/")[2]).iterdir())
    return out


@pytest.fixture()
def table(spark, tmp_path):
    rows = [(str(1000 + i), f"c{i}", ["Tech", "Auto Parts", "A/B:c", None][i % 4], f"text {i}") for i in range(40)]
    folder = f"file://{tmp_path}/t"
    assert report_table.create(spark.createDataFrame(rows, REPORT), folder) == 1
    return folder, {r[0]: r for r in rows}, tmp_path


def held(spark, folder, **more):
    return {r["ticker"]: tuple(r) for r in report_table.load(spark, folder, **more).select(*COLUMNS).collect()}


def test_an_update_of_one_sector_leaves_the_others_alone(spark, table):
    folder, rows, root = table
    before = stat(root, spark, folder)
    changed = report_table.merge(spark.createDataFrame([("1000", "c0", "Tech", "new"), ("1500", "x", "Tech", "added")], REPORT), folder)
    after = stat(root, spark, folder)
    assert changed == {"Tech": "rewritten"}
    assert {s for s in before if before[s] != after[s]} == {"Tech"}
    want = rows | {"1000": ("1000", "c0", "Tech", "new"), "1500": ("1500", "x", "Tech", "added")}
    assert held(spark, folder) == want
    assert held(spark, folder, version=1) == rows
    assert held(spark, folder, sectors=["Tech"]) == {t: r for t, r in want.items() if r[2] == "Tech"}
    plan = report_table.load(spark, folder, ["Tech"])
    assert len({f.rpartition("/")[0] for f in plan.inputFiles()}) == 1


def test_moves_deletions_and_null_sectors(spark, table):
    folder, rows, root = table
    changes = [("1000", "c0", "Auto Parts", "moved"), ("1003", None, None, "null sector"), ("1002", None, "A/B:c", None), ("9999", None, None, None), ("1600", None, "New", "first")]
    before = stat(root, spark, folder)
    assert report_table.merge(spark.createDataFrame(changes, REPORT), folder) == {report_table.NO_SECTOR: "rewritten", "A/B:c": "rewritten", "Auto Parts": "rewritten", "New": "new", "Tech": "rewritten"}
    want = {t: r for t, r in (rows | {c[0]: c for c in changes}).items() if r[3] is not None}
    assert held(spark, folder) == want
    assert report_table.merge(spark.createDataFrame([("1600", None, None, None)], REPORT), folder) == {"New": "gone"}
    del want["1600"]
    assert held(spark, folder) == want and report_table.merge(spark.createDataFrame([], REPORT), folder) == {}
    data = [p for p in (root / "t" / "data").iterdir()]
    assert len(data) <= 2 * 5 and set(before) == {*stat(root, spark, folder)}  # older versions are cleared away


def test_many_updates_agree_with_a_dictionary(spark, table):
    folder, rows, _ = table
    rng, want = random.Random(2), dict(rows)
    for k in range(3):
        picked = {str(rng.randrange(1000, 1060)): (rng.choice(["Tech", "Auto Parts", "Other"]), None if rng.random() < 0.3 else f"v{k}") for _ in range(12)}
        changes = [(t, "c", s, c) for t, (s, c) in picked.items()]
        report_table.merge(spark.createDataFrame(changes, REPORT), folder)
        want = {t: r for t, r in (want | {c[0]: c for c in changes}).items() if r[3] is not None}
    assert held(spark, folder) == want


def test_a_second_writer_fails_and_harms_nothing(spark, table, monkeypatch):
    folder, rows, _ = table
    change = spark.createDataFrame([("1000", "c0", "Tech", "mine")], REPORT)
    plain = manifest.swap

    def other_first(f, version, content):
        plain(f, version, manifest.read(f)[1])
        return plain(f, version, content)

    monkeypatch.setattr(manifest, "swap", other_first)
    with pytest.raises(RuntimeError, match="has changed"):
        report_table.merge(change, folder)
    monkeypatch.setattr(manifest, "swap", plain)
    assert held(spark, folder) == rows
    with pytest.raises(ValueError, match="twice"):
        report_table.merge(change.unionByName(change), folder)
