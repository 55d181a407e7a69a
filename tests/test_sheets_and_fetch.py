"""Spreadsheets made by hand, and a local HTTP service."""

import json
import threading
import time
import urllib.parse
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from fathomtext.sources import fetch
from fathomtext.sources.reports import read_roster
from fathomtext.sources.sheets import SheetSource, column_of

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows, strings, sheet=1):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"xl/worksheets/sheet{sheet}.xml", f'<?xml version="1.0"?><worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<?xml version="1.0"?><sst {MAIN}>{"".join(strings)}</sst>')


def test_sheet_reads_like_its_csv(spark, tmp_path):
    strings = ["<si><t>台積電</t></si>", "<si><r><t>Two </t></r><r><t>styles &amp; more</t></r><rPh><t>aid</t></rPh></si>", "<si><t/></si>", '<si><t xml:space="preserve"> 0050 </t></si>']
    rows = """<row r="1"><c r="A1"><v>2330</v></c><c r="B1" t="s"><v>0</v></c><c r="D1"><v>9</v></c></row>
    <row r="2"><c r="A2"><v>1101.0</v></c></row><row r="4"><c r="A4" t="s"><v>3</v></c><c r="B4" t="s"><v>1</v></c></row>
    <row r="5"><c r="B5" t="s"><v>0</v></c></row><row r="6"/><row r="7"><c t="inlineStr"><is><t>2454</t></is></c><c t="s"><v>2</v></c></row>
    <row r="8"><c r="A8" t="str"><v>12.5</v></c><c r="B8" t="b"><v>1</v></c></row><row r="9"><c r="A9" t="e"><v>#N/A</v></c></row>"""
    workbook(tmp_path / "r.xlsx", rows, strings)
    (tmp_path / "r.csv").write_text("2330,台積電,,9\n1101,\n0050,Two styles & more\n,台積電\n2454,\n12.5,true\n", "utf-8")
    want = [("2330", "台積電"), ("1101", "Unknown"), ("0050", "Two styles & more"), ("2454", "Unknown"), ("12.5", "true")]
    for name in ("r.xlsx", "r.csv"):
        assert [tuple(r) for r in read_roster(spark, f"file://{tmp_path}/{name}").collect()] == want
    assert [r["ticker"] for r in read_roster(spark, f"file://{tmp_path}/r.xlsx", 2).collect()] == ["2330", "1101"]
    spark.dataSource.register(SheetSource)
    typed = spark.read.format("sheet").schema("a int, b string, c string, d double").option("skip", "1").load(f"file://{tmp_path}/r.xlsx")
    assert [r["a"] for r in typed.collect()] == [1101, 50, None, 2454, 12]
    assert spark.read.format("sheet").schema("a int, b string, c string, d double").load(f"file://{tmp_path}/r.xlsx").first()["d"] == 9.0


def test_folders_and_other_sheets(spark, tmp_path):
    spark.dataSource.register(SheetSource)
    for k in range(3):
        workbook(tmp_path / f"{k}.xlsx", "".join(f'<row><c><v>{1000 * k + i}</v></c></row>' for i in range(200)), [], sheet=2)
    got = spark.read.format("sheet").option("sheet", "2").load(f"file://{tmp_path}")
    assert got.count() == 600 and got.rdd.getNumPartitions() == 3 and got.where("name is not null").count() == 0
    assert spark.read.format("sheet").load(f"file://{tmp_path / 'none'}" if (tmp_path / "none").mkdir() else f"file://{tmp_path}/none").count() == 0
    assert [column_of(x, 0) for x in ("A1", "Z9", "AA1", "BC12", None)] == [0, 25, 26, 54, 0]


@pytest.fixture()
def service():
    """Statements of 30 tickers; every third request fails once."""
    asked, failed = [], set()
    tickers = [str(1000 + i) for i in range(30)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            asked.append((time.monotonic(), self.path))
            if len(asked) % 3 == 0 and self.path not in failed:
                failed.add(self.path)
                return self.send_error(503)
            parts, query = url.path.strip("/").split("/"), dict(urllib.parse.parse_qsl(url.query))
            if parts[0] == "broken":
                return self.send_error(500)
            if len(parts) == 2:
                rows = [{"ticker": t, "bytes": 400} for t in tickers]
            elif parts[2] not in tickers:
                return self.send_error(404)
            else:
                rows = [{"ticker": parts[2], "source": "TW", "period_kind": "A", "period_end": f"{y}-12-31", "statement": "income", "item": "Total Revenue", "value": y * 1.5 if y != 2021 else None} for y in range(2019, 2025)]
                rows = [r for r in rows if query.get("from", "") <= r["period_end"] <= query.get("to", "9")]
            body = "\n".join(map(json.dumps, rows)).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_fetch_pushes_filters_and_tries_again(spark, service):
    url, asked = service
    fetch.register(spark)
    rows = spark.read.format("market").option("pause", "0.05").option("task_bytes", "4000").load(f"{url}/api")
    assert rows.rdd.getNumPartitions() == 3
    assert rows.count() == 180 and rows.where("value is null").count() == 30
    asked.clear()
    one = rows.where("ticker = '1007' and period_end >= '2022-01-01' and period_end < '2024-12-31' and value > 0")
    assert one.rdd.getNumPartitions() == 1
    assert sorted(str(r["period_end"]) for r in one.collect()) == ["2022-12-31", "2023-12-31"]
    assert {p for _, p in asked} == {"/api/statements/1007?from=2022-01-01&to=2024-12-30"}
    some = rows.where(F.col("ticker").isin("1001", "1002", "nobody"))
    assert some.count() == 12
    assert rows.where("ticker = '1001' and ticker = '1002'").count() == 0
    assert rows.where("period_end > '2023-12-31' and period_end < '2023-01-01'").count() == 0


def test_fetch_keeps_to_its_rate(spark, service):
    url, asked = service
    fetch.register(spark)
    rows = spark.read.format("market").option("pause", "0.01").option("rate", "10").load(f"{url}/api").where(F.col("ticker").isin(*(str(1000 + i) for i in range(8))))
    asked.clear()
    assert rows.count() == 48
    first = {}
    for at, path in asked:
        first.setdefault(path, at)
    assert max(first.values()) - min(first.values()) >= 0.69


def test_fetch_gives_up_in_the_end(spark, service):
    url, _ = service
    fetch.register(spark)
    rows = spark.read.format("market").option("pause", "0.01").option("retries", "2").load(f"{url}/broken").where("ticker = '1001'")
    with pytest.raises(Exception, match="HTTP Error 50"):
        rows.count()
