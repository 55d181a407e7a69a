"""Many keywords in one scan find what each finds by itself."""

import random
import time

from pyspark.sql import functions as F
from test_reports import BODY

from fathomtext.operators import discover


def test_many_keywords_equal_one_by_one(spark, monkeypatch):
    rng = random.Random(2)
    words = ["HBM", "HBM3", "AI", "AI 伺服器", "設備", "設", "a.b", "\\E", "[[AI", "$x", "中游\n甲", "nowhere", "x" * 40, "é"]
    rows = []
    for i in range(25):
        middle = " ".join(rng.choice([*words, f"[[{rng.choice(words)}]]", "fill", "fill"]) for _ in range(rng.randrange(60)))
        rows.append((str(1000 + i), f"c{i}", rng.choice(["A", "B"]), BODY.replace("生產", middle) if i % 5 else middle))
    rows.append(("2000", None, "A", None))
    reports = spark.createDataFrame(rows, "ticker string, company string, sector string, content string")
    asked = spark.createDataFrame([(w,) for w in [*words, "HBM", "", None]], "keyword string")
    for stretch in (8192, 50):
        monkeypatch.setattr(discover.found_keywords, "__defaults__", (stretch,))
        got = {tuple(map(str, r)) for r in discover.hits_of_many(reports, asked).collect()}
        want = {tuple(map(str, (w, *r))) for w in words for r in discover.hits(reports, w).collect()}
        assert got == want
    some = discover.hits_of_many(reports, asked, ["A"])
    assert {r["sector"] for r in some.collect()} == {"A"}
    assert discover.hits_of_many(reports, asked.limit(0)).columns == some.columns


def test_ten_thousand_keywords_take_one_scan(spark, tmp_path):
    rows = [(str(1000 + i), "c", "A", f"## 業務簡介\nword{i} and name{i % 100} 產品{i * 7} end") for i in range(300)]
    spark.createDataFrame(rows, "ticker string, company string, sector string, content string").repartition(4).write.parquet(str(tmp_path / "r"))
    reports = spark.read.parquet(str(tmp_path / "r"))
    asked = spark.range(10_000).select(F.concat(F.when(F.col("id") % 2 == 0, "word").otherwise("產品"), F.col("id").cast("string")).alias("keyword"))
    found = discover.hits_of_many(reports, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the reports are read once and not moved; what is exchanged are keywords
    assert plan.count("FileScan parquet") == 1 and "Python" not in plan
    got = {(r["keyword"], r["ticker"]) for r in found.collect()}
    keywords = [("word" if k % 2 == 0 else "產品") + str(k) for k in range(10_000)]
    texts = {t: c for t, _, _, c in rows}
    assert got == {(k, t) for t, c in texts.items() for k in {w[:n] for w in c.split() for n in range(1, len(w) + 1)} & set(keywords)}


def test_time_grows_with_the_text(spark):
    reports = spark.range(200).selectExpr("CAST(id AS STRING) AS ticker", "'a' AS company", "'s' AS sector", "repeat('abcdefg hi', 200) || 'KEY' || id || '.' AS content")
    keywords = spark.createDataFrame([(w,) for w in ("KEY7.", "KEY1", "no such", "hi", "none at all")], "keyword string")
    began = time.time()
    found = {(r["keyword"], r["ticker"]) for r in discover.hits_of_many(reports, keywords).collect()}
    assert time.time() - began < 60
    assert found == {("KEY7.", "7")} | {("hi", str(i)) for i in range(200)} | {("KEY1", str(i)) for i in range(200) if str(i).startswith("1")}
