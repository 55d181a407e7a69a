"""Writers: report tables, graph JSON, index and theme pages, the graph page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import vocabulary as V
from .fileset import write_files


def write_reports(reports: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Reports as a table laid out by sector, in a new path (never one that is being read); with dry_run nothing is written. Returns what is or would be there."""
    if not dry_run:
        reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sector").parquet(path)
        return reports.sparkSession.read.schema(reports.schema).parquet(path)
    return reports


def markdown_files(reports: DataFrame, tree: str | None = None) -> DataFrame:
    """path and content as the folder layout has them: <sector>/<ticker>_<company>.md; tree: a column with the folder above the sector's."""
    above = [] if tree is None else [F.col(tree)]
    return reports.select(F.concat_ws("/", *above, X.folder_name(F.col("sector")), F.concat(F.col("ticker"), F.lit("_"), F.col("company"), F.lit(".md"))).alias("path"), "content")


def write_markdown(files: DataFrame, folder: str, dry_run: bool = False) -> int:
    """Write path, content rows (as markdown_files gives them) as files below a folder that all executors reach, in one transaction; returns their number.

    If a task fails, the files from before stay. With dry_run the files are only counted. Rows
    without content write no file.
    """
    rows = files.where("content is not null and path is not null")
    return rows.count() if dry_run else write_files(rows, folder)


#: Nodes or edges that a page can show; a larger graph has to be bounded by min_weight or top first.
GRAPH_ROWS = 50_000


def graph_json(nodes: DataFrame, edges: DataFrame, indent: int = 2, most: int = GRAPH_ROWS) -> str:
    """Nodes by count, edges by weight, as one JSON text. More than most of either is an error, as one page cannot show them."""
    n = [r.asDict() for r in nodes.orderBy(F.desc("count"), "id").limit(most + 1).collect()]
    e = [r.asDict() for r in edges.orderBy(F.desc("weight"), "source", "target").limit(most + 1).collect()]
    if max(len(n), len(e)) > most:
        raise ValueError(f"over {most} nodes or edges: raise the least weight or take the most frequent names only")
    return json.dumps({"nodes": n, "links": e}, ensure_ascii=False, indent=indent)


def graph_page(graph: str, title: str = "Entity network") -> str:
    """A self-contained page that draws the graph on a spiral, the most frequent in the middle; by weight and name what is shown shrinks, a click leaves a node and its neighbours."""
    legend = "".join(f'<li style="color:{c}">{html.escape(V.CATEGORY_LABELS[k])}</li>' for k, c in V.CATEGORY_COLORS.items())
    data = graph.replace("</", "<\\/")
    return f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>
<h1>{html.escape(title)}</h1><ul>{legend}</ul>
<label>Least weight <input id="w" type="number" value="5"></label> <label>Name <input id="q"></label>
<canvas id="c" width="1200" height="800"></canvas><table id="t"></table>
<script>
const graph = {data}, canvas = document.getElementById("c"), pen = canvas.getContext("2d");
const most = Math.max(1, ...graph.nodes.map(n => n.count)), ends = graph.links.map(l => l.weight), lo = Math.min(...ends), hi = Math.max(...ends);
const size = n => most > 1 ? 4 + 36 * (Math.sqrt(n.count) - 1) / (Math.sqrt(most) - 1) : 4, share = l => hi > lo ? (l.weight - lo) / (hi - lo) : 0;
const reach = i => 380 * Math.sqrt(i / graph.nodes.length), at = new Map(graph.nodes.map((n, i) => [n.id, {{ ...n, x: 600 + reach(i) * Math.cos(i * 2.4), y: 400 + reach(i) * Math.sin(i * 2.4) }}]));
let chosen = null, shown = [], points = [];
function pick() {{
  const w = +document.getElementById("w").value, q = document.getElementById("q").value.toLowerCase();
  shown = graph.links.filter(l => l.weight >= w && (!chosen || l.source === chosen || l.target === chosen) && (l.source + " " + l.target).toLowerCase().includes(q));
  points = [...new Set(shown.flatMap(l => [l.source, l.target]))].map(id => at.get(id)).filter(Boolean);
  document.getElementById("t").replaceChildren(...shown.map(l => {{
    const tr = document.createElement("tr");
    for (const x of [l.source, l.target, l.weight]) tr.insertCell().textContent = x;
    return tr;
  }}));
  draw();
}}
function draw() {{
  pen.clearRect(0, 0, 1200, 800);
  for (const l of shown) {{
    const a = at.get(l.source), b = at.get(l.target);
    pen.globalAlpha = 0.15 + 0.45 * share(l); pen.lineWidth = 0.5 + 3.5 * share(l);
    pen.beginPath(); pen.moveTo(a.x, a.y); pen.lineTo(b.x, b.y); pen.stroke();
  }}
  pen.globalAlpha = 1;
  for (const a of points) {{
    pen.fillStyle = a.color; pen.beginPath(); pen.arc(a.x, a.y, size(a), 0, 7); pen.fill();
    pen.fillStyle = "#222"; pen.fillText(a.id, a.x + size(a) + 2, a.y);
  }}
}}
canvas.onclick = e => {{
  const hit = points.find(a => Math.hypot(a.x - e.offsetX, a.y - e.offsetY) < size(a) + 3);
  chosen = hit ? hit.id : null;
  pick();
}};
for (const id of ["w", "q"]) document.getElementById(id).oninput = pick;
pick();
</script></body></html>"""


def theme_lines(screened: DataFrame, themes: DataFrame, counts: DataFrame) -> DataFrame:
    """file, part, sector, ticker, line: the lines of each theme's page; in this order they are the page.

    screened: entries of themes; themes: tag, name, description, related; counts: tag, companies.
    A theme without companies has no page. No page is gathered into one row.
    """
    about = F.broadcast(themes).join(counts, "tag")
    pairs = F.broadcast(themes.select("tag", F.posexplode("related").alias("ord", "other"))).join(counts.select(F.col("tag").alias("other"), "companies"), "other")
    linked = pairs.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("[["), "other", F.lit("]] ("), F.col("companies").cast("string"), F.lit(")")).alias("t")))).alias("l"))  # as many as a theme names
    more = F.when(F.col("l").isNotNull(), F.array(F.concat(F.lit("**相關主題:** "), F.array_join(F.transform("l", lambda x: x["t"]), " | ")), F.lit(""))).otherwise(F.array().cast("array<string>"))
    top = F.concat(F.array(F.concat(F.lit("# "), "name"), F.lit(""), F.concat(F.lit("> "), "description"), F.lit(""), F.concat(F.lit("**涵蓋公司數:** "), F.col("companies").cast("string")), F.lit("")), more, F.array(F.lit("---"), F.lit("")))
    none = F.lit("")
    head = about.join(linked, "tag", "left").select("tag", F.posexplode(top).alias("part", "line")).select("tag", "part", none.alias("sector"), none.alias("ticker"), "line")
    place, label = X.literal_map({r: str(100 * (i + 1)) for i, r in enumerate(V.ROLE_LABELS)}), X.literal_map(V.ROLE_LABELS)
    first = place[F.col("role")].cast("int")
    roles = screened.groupBy("tag", "role").agg(F.count(F.lit(1)).alias("n"))
    title = F.concat(F.lit("## "), label[F.col("role")], F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    around = roles.select("tag", first.alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("o"), title.alias("line")), F.struct(F.lit(1).alias("o"), none.alias("line")), F.struct(F.lit(3).alias("o"), none.alias("line")))).alias("x"))
    around = around.select("tag", (F.col("part") + F.col("x.o")).alias("part"), none.alias("sector"), none.alias("ticker"), "x.line")
    company = F.concat(F.lit("- **"), "ticker", F.lit(" "), F.coalesce("company", none), F.lit("** ("), "sector", F.lit(")"))
    rows = head.unionByName(around).unionByName(screened.select("tag", (first + 2).alias("part"), "sector", "ticker", company.alias("line")))
    return rows.select(F.concat(X.file_stem(F.col("tag")), F.lit(".md")).alias("file"), "part", "sector", "ticker", "line")


def theme_index_lines(index: DataFrame) -> DataFrame:
    """file, part, sector, ticker, line of the themes' README. index: category, ord, tag, companies, a row for each listed theme."""
    place = X.literal_map({f"{c}/{t}": str(i) for i, (c, t) in enumerate((c, t) for c, ts in V.THEME_INDEX.items() for t in ts)})
    row = F.concat(F.lit("- ["), "tag", F.lit("]("), X.file_stem(F.col("tag")), F.lit(".md) — "), F.col("companies").cast("string"), F.lit(" 家公司"))
    spark = index.sparkSession
    fixed = [(i, line) for i, line in enumerate(V.THEME_INDEX_HEAD)]
    for k, category in enumerate(V.THEME_INDEX):
        fixed += [(1000 * (k + 1), f"## {category}"), (1000 * (k + 1) + 1, ""), (1000 * (k + 1) + 999, "")]
    rows = spark.createDataFrame(fixed, "part int, line string").unionByName(index.select(((F.col("ord") + 1) * 1000 + 2 + place[F.concat("category", F.lit("/"), "tag")].cast("int")).alias("part"), row.alias("line")))
    return rows.select(F.lit("README.md").alias("file"), "part", F.lit("").alias("sector"), F.lit("").alias("ticker"), "line")


def write_pages(lines: DataFrame, folder: str) -> int:
    """Write file, part, sector, ticker, line rows as text files in that order, streaming and in one transaction; returns the number of files."""
    dealt = lines.select("file", "part", "sector", "ticker", "line").repartition("file").sortWithinPartitions("file", "part", "sector", "ticker")
    return write_files(dealt.select(F.col("file").alias("path"), F.col("line").alias("content")), folder)
