"""The commands, the landing source and the page writers on a small folder of reports."""

import json

import pytest
from test_reports import BODY

from fathomtext.__main__ import parser, run
from fathomtext.sources import market


@pytest.fixture()
def folder(tmp_path):
    for sector, name, text in (("Semiconductors", "1101_甲電", BODY), ("Auto Parts", "1102_乙車", BODY.replace("1101", "1102").replace("NVIDIA", "Tesla").replace("上游", "中游", 1))):
        (tmp_path / sector).mkdir(exist_ok=True)
        (tmp_path / sector / f"{name}.md").write_text(text, "utf-8")
    (tmp_path / "task.txt").write_text("- [x] **Batch 1** (All): 1101, 1102, 1103.\n", "utf-8")
    return tmp_path


def call(spark, folder, *words):
    return run(spark, parser().parse_args(["--reports", f"file://{folder}", "--checklist", f"file://{folder}/task.txt", *words]))


def test_audit_and_discover(spark, folder):
    assert {(r["batch"], r["total"], r["missing"]) for r in call(spark, folder, "audit", "1").collect()} == {(1, 3, 1)}
    assert call(spark, folder, "audit", "--all").first()["total"] == 2
    assert [r["ticker"] for r in call(spark, folder, "audit", "1", "-v").collect()][-1] == "1103"
    assert [r["ticker"] for r in call(spark, folder, "discover", "生產").collect()] == ["1101", "1102"]
    assert [r["ticker"] for r in call(spark, folder, "discover", "生產", "--sector", "Auto", "Parts").collect()] == ["1102"]
    assert call(spark, folder, "--dry-run", "discover", "設備", "--apply") == 2
    assert call(spark, folder, "discover", "設備", "--apply") == 2
    assert "[[設備]]" in (folder / "Auto Parts" / "1102_乙車.md").read_text("utf-8")


def test_add_enrich_and_organize(spark, folder):
    assert call(spark, folder, "add", "1109", "丙", "--sector", "Tech") == 1 and "[[丙]]" in (folder / "Tech" / "1109_丙.md").read_text("utf-8")
    assert call(spark, folder, "add", "1101", "甲電") == 0
    (folder / "data.json").write_text(json.dumps({"1102": {"desc": "new words"}}), "utf-8")
    assert call(spark, folder, "enrich", "--data", f"file://{folder}/data.json", "1102", "1101") == 1
    assert "new words" in (folder / "Auto Parts" / "1102_乙車.md").read_text("utf-8")
    assert call(spark, folder, "--out", f"file://{folder}/by", "organize") == 3


def test_pages(spark, folder):
    assert call(spark, folder, "themes") > 3
    page = (folder / "themes" / "NVIDIA.md").read_text("utf-8")
    assert page.startswith("# NVIDIA") and "**涵蓋公司數:** 1" in page and page.index("## 上游 (1)") < page.index("- **1101 甲電** (Semiconductors)")
    index = (folder / "themes" / "README.md").read_text("utf-8")
    assert "- [NVIDIA](NVIDIA.md) — 1 家公司" in index and index.index("## 先進封裝") < index.index("## 通訊")
    assert call(spark, folder, "themes", "--list").where("companies > 0").count() > 3
    assert call(spark, folder, "network", "--min-weight", "2") == 2
    graph = json.loads((folder / "network" / "graph_data.json").read_text("utf-8"))
    assert graph["links"] and "canvas" in (folder / "network" / "index.html").read_text("utf-8")
    assert call(spark, folder, "index") == 1 and "- [[AI 伺服器]] (" in (folder / "WIKILINKS.md").read_text("utf-8")


def test_financials_from_landing_files(spark, folder, tmp_path):
    rows = [{"ticker": "1101", "source": "TW", "period_kind": k, "period_end": f"202{y}-12-31", "statement": "income", "item": i, "value": v * 1e6 + y} for k in "AQ" for y in range(5) for i, v in (("Total Revenue", 100), ("Gross Profit", 40))]
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "a.jsonl").write_text("\n".join(map(json.dumps, [*rows, {"ticker": "1102", "value": float("nan")}])), "utf-8")
    (tmp_path / "quotes").mkdir()
    (tmp_path / "quotes" / "a.json").write_text(json.dumps({"ticker": "1101", "source": "TW", "trailingPE": 12, "currentPrice": 50, "marketCap": 3e9}), "utf-8")
    spark.dataSource.register(market.LandingSource)
    got = spark.read.format("landing").load(f"file://{tmp_path}/landing")
    assert got.count() == 21 and got.where("value is null").count() == 1
    got.write.parquet(f"file://{tmp_path}/statements.parquet")
    spark.read.format("landing").option("kind", "quotes").load(f"file://{tmp_path}/quotes").write.parquet(f"file://{tmp_path}/quotes.parquet")
    assert call(spark, folder, "--statements", f"file://{tmp_path}/statements.parquet", "--quotes", f"file://{tmp_path}/quotes.parquet", "financials") == 1
    text = (folder / "Semiconductors" / "1101_甲電.md").read_text("utf-8")
    assert "12.00" in text and "40.00" in text and "**市值:** 3,000" in text and text.count("2024-12-31") == 2
    assert call(spark, folder, "--quotes", f"file://{tmp_path}/quotes.parquet", "valuation", "1101") == 1
