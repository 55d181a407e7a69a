"""Report grammar: links, sections, roles, discovery, audit, upserts and ingest on small made-up reports."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from fathomtext.functions import text as X
from fathomtext.operators import audit, discover, network, statements, themes, upsert
from fathomtext.operators.mentions import bag_counts, index, report_mentions
from fathomtext.operators.scope import Scope, in_sectors, parse_batches, profile_of, profile_sectors
from fathomtext.plans import vocabulary as V
from fathomtext.sources import reports as S
from fathomtext.sources import sinks

BODY = """# 1101 - [[甲電]]

## 業務簡介
**板塊:** Tech
**產業:** Semiconductors
**市值:** 1,000 百萬台幣
**企業價值:** 2,000 百萬台幣

甲電 生產 [[CoWoS]] 與 [[HBM]] 相關 設備，主要 產品 為 [[AI 伺服器]] 與 [[PCB]]。

## 供應鏈位置
上游 [[NVIDIA]] 供貨
中游 甲電
下游 [[Apple]]

## 主要客戶及供應商
一 [[Intel]]
### 主要客戶
二 [[Dell]]
三 [[HP]]
四 [[Google]]

## 財務概況 (單位: 百萬台幣, 只有 Margin 為 %)
### 估值指標
old
### 年度關鍵財務數據 (近 3 年)
x [[財務]]
"""


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.fixture()
def report(spark):
    return spark.createDataFrame([("1101", "甲電", "Semiconductors", BODY)], "ticker string, company string, sector string, content string")


def test_links_of_nested_brackets(spark):
    assert one(spark, X.links(F.col("t")), t="[[AI[[伺服器]]]]") == ["AI[[伺服器"]


def test_linked_bare_and_taggable_counts(spark):
    t = "AI and [[AI]] and [[AI 伺服器]] 生成式AI [[生成式AI]] [[xAIy]] AI晶片"
    assert one(spark, X.occurrences(F.col("t"), X.linked_pattern("AI")), t=t) == 1
    assert one(spark, X.occurrences(F.col("t"), X.bare_pattern("AI")), t=t) == 4
    assert one(spark, X.occurrences(F.col("t"), X.taggable_pattern("AI")), t=t) == 2


def test_theme_sections_end_at_any_heading_unless_h2_is_asked(spark, report):
    compat = {r["tag"]: r["role"] for r in themes.entries(report).collect()}
    assert "Dell" not in compat and compat["NVIDIA"] == "upstream" and compat["Intel"] == "related"
    assert "Dell" in {r["tag"] for r in themes.entries(report, "h2").collect()}


def test_role_precedence_and_reach(spark):
    role = lambda t: one(spark, X.positional_role(F.col("t"), F.lit("K")), t=t)
    assert role("中游 x 上游 K") == "upstream" and role("下游 中游 K") == "downstream"
    assert role("上游" + "x" * 100 + "K") == "related" and role("nothing") == "related"


def test_section_role(spark):
    assert one(spark, X.section_role(F.col("t"), "甲"), t="# 甲\n## 業務簡介\nb\n") == "mentioned"
    assert one(spark, X.section_role(F.col("t"), "甲"), t="# x\n## 業務簡介\nb\n## 供應鏈位置\n甲\n") == "supply_chain"


def test_overlapping_snippets(spark):
    t = "a KW b KW c\nKW d KW"
    got = one(spark, X.snippets(F.col("t"), "KW"), t=t)
    assert got == ["..." + t.replace("\n", " ") + "..."] * 3
    assert one(spark, X.snippets(F.col("t"), "KW"), t="none") == []


def test_aliases_and_repeats(spark):
    end = "\n## 財務概況\n[[TSMC]]\n## 財務概況 again"
    assert one(spark, X.normalize_links(F.col("t")), t="[[TSMC]] ([[台積電]])" + end) == "[[台積電]]" + end
    assert one(spark, X.normalize_links(F.col("t")), t="[[A]]（[[A]]） [[A]] ([[B]])" + end) == "[[A]] [[A]] ([[B]])" + end
    assert one(spark, X.normalize_links(F.col("t")), t="[[TSMC]]") == "[[TSMC]]"


@pytest.mark.parametrize(("name", "category"), [("5G", "technology"), ("碳化矽", "material"), ("無人機", "application"), ("台積電", "taiwan_company"), ("Intel", "international_company"), ("", "international_company")])
def test_categories(spark, name, category):
    assert one(spark, X.categorize(F.col("n")), n=name) == category


def test_index_keeps_listed_terms(spark):
    rows = spark.createDataFrame([("X",), ("X",), ("Y",), ("AI",)], "name string")
    assert {r["name"] for r in index(bag_counts(rows)).collect()} == {"X", "AI"}


def test_report_mentions_scope(spark, report):
    assert "財務" not in {r["name"] for r in report_mentions(report).collect()}
    assert "財務" in {r["name"] for r in report_mentions(report, whole=True).collect()}


def test_network_ties_and_semantics(spark):
    rows = spark.createDataFrame([(d, n) for d, ns in {1: "ABC", 2: "ABC", 3: "AB", 4: "D"}.items() for n in ns] + [(1, "A"), (None, "A"), (5, None)], "k int, name string")
    got = {(r["source"], r["target"]): r["weight"] for r in network.edges(rows, "k", min_weight=2).collect()}
    assert got == {("A", "B"): 3, ("A", "C"): 2, ("B", "C"): 2}
    top = {(r["source"], r["target"]) for r in network.edges(rows, "k", min_weight=1, top=2).collect()}
    assert top == {("A", "B")}
    links = network.edges(rows, "k", min_weight=3)
    points = network.nodes(rows, "k", links)
    assert {r["id"] for r in points.collect()} == {"A", "B"}
    graph = json.loads(sinks.graph_json(points, links))
    assert graph["links"] == [{"source": "A", "target": "B", "weight": 3}] and "<script>" in sinks.graph_page(json.dumps(graph))


def test_discovery(spark, report):
    got = discover.hits(report, "甲電").first()
    assert (got["linked"], got["bare"], got["role"]) == (1, 2, "core_business") and len(got["contexts"]) == 2
    tagged = discover.tagged(report, "甲電").first()
    assert tagged["applied"] == 2 and "[[財務]]" in tagged["content"]
    assert discover.hits(report, "甲電", ["semiconductors"]).count() == 0


def test_scope(spark, report):
    assert Scope.parse(["abc"]).of(report).count() == 0 and Scope.parse([]).of(report).count() == 1
    assert Scope.parse(["--sector", "semiconductors"]).of(report).count() == 1
    batches = parse_batches(spark.createDataFrame([("- [x] **Batch 2** (A & B): 1101, 2630 x, zz.",), ("other",)], "value string"))
    assert batches.first().asDict() == {"batch": 2, "done": True, "sector": "A & B", "tickers": ["1101", "2630"]}
    assert Scope.parse(["--batch", "2"], batches).of(report).count() == 1
    assert profile_of("液冷散熱") == "tech" and profile_of("氫能") == "energy" and profile_of("x") == "all"
    assert profile_sectors("all") is None and in_sectors(report, profile_sectors("tech")).count() == 1


def issues(spark, text):
    return one(spark, audit.issues(F.col("t")), t=text)


def test_audit_rules(spark, report):
    assert issues(spark, "x" * 199) == ["Content too short (<200 chars)"]
    assert issues(spark, BODY) == []
    few = BODY.replace("[[Dell]]", "Dell").replace("[[HP]]", "HP").replace("[[Google]]", "Google").replace("[[財務]]", "").replace("[[Intel]]", "Intel").replace("[[PCB]]", "某大廠")
    assert [i for i in issues(spark, few) if i.startswith("Only")] == ["Only 6 wikilinks (minimum 8)"]
    assert "Generic wikilinks (1): ['大廠']" in issues(spark, BODY.replace("[[PCB]]", "[[大廠]]"))
    assert "Missing section: ## 供應鏈位置" in issues(spark, BODY.replace("## 供應鏈位置", "## 供應"))
    assert "Empty metadata: 產業:" in issues(spark, BODY.replace("Semiconductors", "(待更新)"))
    assert "English text detected: 'Inc.'" in issues(spark, BODY.replace("生產", "Inc. 生產"))
    assert "Supply chain too thin (2 lines)" in issues(spark, BODY.replace("中游 甲電\n", "\n"))


def test_audit_scores(spark, report):
    batches = spark.createDataFrame([(1, ["1101", "9999"])], "batch int, tickers array<string>")
    rows = audit.audit(batches, report)
    assert {r["ticker"]: r["status"] for r in rows.collect()} == {"1101": "CLEAN", "9999": "MISSING"}
    assert audit.batch_scores(rows, "batch").first()["pct"] == 50.0
    assert audit.overall_score(rows).first()["pct"] == 100.0


def statement(item, value, end="2024-12-31", kind="A", ticker="1"):
    return (ticker, "TW", kind, date.fromisoformat(end), "income", item, value)


def test_statement_metrics(spark):
    rows = [
        statement("Total Revenue", 2e6), statement("Gross Profit", 1e6), statement("Net Income Common Stockholders", 5e5), statement("Net Income", None),
        statement("Selling General And Administration", 3e5), statement("Selling And Marketing Expense", 1e5), statement("General And Administrative Expense", float("nan")),
        statement("Free Cash Flow", 1e5), statement("Operating Cash Flow", 4e5), statement("Total Revenue", 0.0, "2023-12-31"), statement("Gross Profit", 1.0, "2023-12-31"), statement("Gross Profit", 1.0, "2022-12-31"),
    ]
    got = {str(r["period_end"]): r for r in statements.metrics(statements.line_items(spark.createDataFrame(rows, "ticker string, source string, period_kind string, period_end date, statement string, item string, value double"))).collect()}
    assert set(got) == {"2024-12-31", "2023-12-31"} and got["2023-12-31"]["gross_margin"] is None
    new = got["2024-12-31"]
    assert (new["gross_margin"], new["net_income"], new["capex"]) == (50.0, None, pytest.approx(-0.3)) and new["admin_exp"] == pytest.approx(0.2)


def test_rendered_section(spark):
    rows = [statement("Total Revenue", 2e6), statement("Total Revenue", 1e6, "2023-12-31"), statement("Gross Profit", 1e6)]
    items = statements.line_items(spark.createDataFrame(rows, "ticker string, source string, period_kind string, period_end date, statement string, item string, value double"))
    table = statements.rendered(statements.metrics(items)).first()["table"]
    assert table.split("\n")[:5] == ["|  | 2024-12-31 | 2023-12-31 |", "|:---|---:|---:|", "| Revenue | 2.00 | 1.00 |", "| Gross Profit | 1.00 | - |", "| Gross Margin (%) | 50.00 | - |"]
    whole = one(spark, statements.financial_section(F.lit(None).cast("string"), F.col("t"), F.lit(None).cast("string")), t="T")
    assert whole == f"{V.FINANCIAL_TITLE}\n{V.ANNUAL_TITLE}\nT\n\n{V.QUARTERLY_TITLE}\n{V.NO_DATA}\n"


def test_latest_reported_periods(spark):
    rows = spark.createDataFrame([("1", "Q", d) for d in ("2024-03-31", "2024-06-30", "2024-12-31", "2025-03-31", "2025-06-30")] + [("1", "A", "2020-12-31")], "ticker string, period_kind string, period_end string")
    got = [r["period_end"] for r in statements.latest(rows).where("period_kind = 'Q'").orderBy("period_end").collect()]
    assert got == ["2024-06-30", "2024-12-31", "2025-03-31", "2025-06-30"]


def test_valuation_and_rendering(spark):
    cols = "ticker string, source string, trailingPE double, forwardPE double, priceToSalesTrailing12Months double, priceToBook double, enterpriseToEbitda double, currentPrice double, mostRecentQuarter bigint, nextFiscalYearEnd bigint, marketCap double, enterpriseValue double"
    rows = [("1", "TW", 0.0, None, 0.125, -3.456, 1234.5, 10.0, 86400, None, 2.5e9, 0.0), ("1", "TWO", 1.0, 1.0, 1.0, 1.0, 1.0, 5.0, 0, 0, 1.0, 1.0), ("2", "TW", 1.0, 1.0, 1.0, 1.0, 1.0, None, 0, 0, 1.0, 1.0), ("2", "TWO", 2.0, 1.0, 1.0, 1.0, 1.0, 5.0, 0, 0, 1.0, 1.0), ("3", "TW", 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0, 0, 1.0, 1.0)]
    got = {r["ticker"]: r for r in statements.valuation(spark.createDataFrame(rows, cols), ["TW", "TWO"], F.lit("2025-01-01")).collect()}
    assert set(got) == {"1", "2"} and got["2"]["source"] == "TWO"
    one_ = got["1"]
    assert [one_[k] for k in V.MULTIPLES] == ["N/A", "N/A", "0.12", "-3.46", "1234.50"]
    assert (one_["market_cap"], one_["enterprise_value"]) == ("2,500", None)
    assert one_["note"] == "股價 $10.00 as of 2025-01-01 | TTM 截至 1970-01-02"
    assert one_["block"].split("\n")[1:] == ["| P/E (TTM) | Forward P/E | P/S (TTM) |   P/B | EV/EBITDA |", "|-----------|-------------|-----------|-------|-----------|", "|       N/A |         N/A |      0.12 | -3.46 |   1234.50 |"]


def test_enrichment(spark, report):
    payload = spark.createDataFrame([("1101", ("新 $1 \\ 描述 [[TSMC]]", None, "客戶 [[輝達]]", None, None)), ("8888", (None,) * 5)], "ticker string, data struct<desc: string, supply_chain: string, cust: string, sector: string, industry: string>")
    got = upsert.enrich(report, payload).first()
    assert got["outcome"] == "ENRICHED" and "企業價值:** 2,000 百萬台幣\n\n新 $1 \\ 描述 [[台積電]]\n\n## 供應鏈位置" in got["content"]
    assert "客戶 [[NVIDIA]]\n\n## 財務概況" in got["content"] and "Dell" not in got["content"]
    assert [r["ticker"] for r in upsert.unmatched(payload, report).collect()] == ["8888"]
    bare = report.withColumn("content", F.lit("# t\n\n## 業務簡介\nold\n## 供應鏈位置\n"))
    assert "## 業務簡介\n**板塊:** N/A\n" in upsert.enrich(bare, payload).first()["content"]


def test_figures(spark, report):
    section = spark.createDataFrame([("1101", "## 財務概況 new\n", "7,777", None)], "ticker string, section string, market_cap string, enterprise_value string")
    got = upsert.update_financials(report, section).first()["content"]
    assert got.endswith("## 財務概況 new\n") and "**市值:** 7,777 百萬台幣" in got and "**企業價值:** 2,000 百萬台幣" in got
    value = spark.createDataFrame([("1101", "### 估值指標 $2\nrow", None, None)], "ticker string, block string, market_cap string, enterprise_value string")
    got = upsert.update_valuation(report, value).first()["content"]
    assert "### 估值指標 $2\nrow\n\n### 年度" in got and "old" not in got


def test_new_reports_and_folders(spark, report):
    roster = spark.createDataFrame([("1101", "甲"), ("2202", None)], "ticker string, name string")
    rows = upsert.new_reports(roster, report).collect()
    assert [r["ticker"] for r in rows] == ["2202"] and rows[0]["content"].startswith("# 2202 - [[Unknown]]\n\n## 業務簡介\n**板塊:** Unknown")
    assert upsert.organized(report).first()["sector"] == "Semiconductors"
    assert one(spark, X.folder_name(F.col("n")), n=' a<>:"/\\|?*b ') == "ab"
    assert sinks.markdown_files(report).first()["path"] == "Semiconductors/1101_甲電.md"


def test_read_and_write(spark, report, tmp_path):
    for folder, name in (("Aerospace & Defense", "1101_甲+公司.md"), ("Other", "1101_乙.md"), ("Other", "2202.md"), ("Other", "notes.md")):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / name).write_text(BODY)
    got = S.read_reports(spark, str(tmp_path / "in")).collect()
    assert [(r["ticker"], r["company"], r["sector"]) for r in got] == [("1101", "乙", "Other")]
    assert S.read_all_markdown(spark, str(tmp_path / "in")).count() == 4
    (tmp_path / "p.json").write_text(json.dumps({"1101": {"desc": "d"}}))
    assert S.read_payload(spark, str(tmp_path / "p.json")).first()["data"]["desc"] == "d"
    (tmp_path / "r.csv").write_text("1101, x\n2202,\n")
    assert [tuple(r) for r in S.read_roster(spark, str(tmp_path / "r.csv")).collect()] == [("1101", "x"), ("2202", "Unknown")]
    back = sinks.write_reports(report, str(tmp_path / "out"))
    assert back.count() == 1 and sinks.write_reports(report, str(tmp_path / "none"), dry_run=True).count() == 1
    assert not (tmp_path / "none").exists()
