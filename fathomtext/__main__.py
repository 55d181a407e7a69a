"""The commands: python -m fathomtext COMMAND --reports FOLDER ... Each reads a folder of reports and writes back what it changed."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import audit, discover, mentions, network, scope, statements, themes, upsert
from .plans import vocabulary as V
from .sources import market, reports, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fathomtext")
    top.add_argument("--reports", required=True, help="URI of the folder of reports")
    top.add_argument("--out", help="URI of the folder to write to; the reports' own if not given")
    top.add_argument("--checklist", help="file with the batches")
    top.add_argument("--statements", help="landing table of statements")
    top.add_argument("--quotes", help="landing table of quotes")
    top.add_argument("--dry-run", action="store_true", help="count what would be written")
    sub = top.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add")
    add.add_argument("ticker")
    add.add_argument("name")
    add.add_argument("--sector", nargs="+")
    for name in ("financials", "valuation", "enrich"):
        one = sub.add_parser(name)
        one.add_argument("--batch")
        one.add_argument("--sector", nargs="+")
        one.add_argument("tickers", nargs="*")
        if name == "enrich":
            one.add_argument("--data", required=True)
    one = sub.add_parser("audit")
    one.add_argument("batch", nargs="?", type=int)
    one.add_argument("--all", action="store_true")
    one.add_argument("-v", "--verbose", action="store_true")
    one = sub.add_parser("discover")
    one.add_argument("keyword")
    for flag in ("--apply", "--rebuild", "--smart"):
        one.add_argument(flag, action="store_true")
    one.add_argument("--sector", nargs="+")
    one.add_argument("--sectors")
    sub.add_parser("index")
    one = sub.add_parser("network")
    one.add_argument("--min-weight", type=int, default=5)
    one.add_argument("--top", type=int, default=0)
    one = sub.add_parser("themes")
    one.add_argument("tag", nargs="?")
    one.add_argument("--list", action="store_true")
    one = sub.add_parser("base-reports")
    one.add_argument("--roster", required=True)
    one.add_argument("--rows", type=int, default=5)
    sub.add_parser("organize")
    return top


def scoped(spark: SparkSession, args: argparse.Namespace) -> scope.Scope:
    words = ["--batch", args.batch] if args.batch else ["--sector", *args.sector] if args.sector else args.tickers
    return scope.Scope.parse(words, batches(spark, args) if args.batch else None)


def batches(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return scope.parse_batches(reports.read_checklist(spark, args.checklist)) if args.checklist else scope.empty_batches(spark)


def put(rows: DataFrame, args: argparse.Namespace, by_path: bool = True) -> int:
    """Write reports to their own paths, or to those of the folder layout."""
    if by_path and not args.out:
        rows = rows.select(F.concat_ws("/", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)).alias("path"), "content")
    else:
        rows = sinks.markdown_files(rows)
    return sinks.write_markdown(rows, args.out or args.reports, args.dry_run)


def write_text(spark: SparkSession, text: str, name: str, args: argparse.Namespace) -> int:
    return sinks.write_markdown(spark.createDataFrame([(name, text)], "path string, content string"), args.out or args.reports, args.dry_run)


def quotes_of(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return statements.valuation(market.read_quotes(spark, args.quotes), market.SOURCES)


def theme_pages(spark: SparkSession, rows: DataFrame, args: argparse.Namespace, tag: str | None = None) -> int:
    entries, table = themes.entries(rows), themes.theme_table(spark)
    counts = themes.company_counts(entries)
    chosen = table.where(F.col("tag") == tag) if tag else table
    lines = sinks.theme_lines(themes.screen(entries, chosen), chosen.drop("related").join(table.select("tag", "related"), "tag"), counts)
    lines = lines.join(chosen.select(F.concat(X.file_stem(F.col("tag")), F.lit(".md")).alias("file")), "file", "left_semi")
    pages = lines.unionByName(sinks.theme_index_lines(themes.theme_index(spark, counts)))
    return pages.select("file").distinct().count() if args.dry_run else sinks.write_pages(pages, f"{args.out or args.reports}/themes")


def network_page(spark: SparkSession, rows: DataFrame, args: argparse.Namespace, min_weight: int = 5, top: int = 0) -> int:
    names = mentions.report_mentions(rows)
    links = network.edges(names, "ticker", min_weight, top=top)
    graph = sinks.graph_json(network.nodes(names, "ticker", links), links)
    return write_text(spark, graph, "network/graph_data.json", args) + write_text(spark, sinks.graph_page(graph), "network/index.html", args)


def index_page(spark: SparkSession, args: argparse.Namespace) -> int:
    every = mentions.mentions(reports.read_all_markdown(spark, args.reports), X.links(F.col("content")))
    ranked = mentions.top_of_each_category(mentions.index(mentions.bag_counts(every)), V.INDEX_LIMITS)
    line = F.concat(F.lit("- [["), "name", F.lit("]] ("), F.col("cnt").cast("string"), F.lit(")"))
    head = ranked.select("category", "total").distinct().select("category", F.lit(0).alias("rank"), F.concat(F.lit("## "), X.literal_map(V.CATEGORY_LABELS)[F.col("category")], F.lit(" ("), F.col("total").cast("string"), F.lit(")")).alias("line"))
    lines = head.unionByName(ranked.select("category", F.col("rank").cast("int").alias("rank"), line.alias("line")))
    pages = lines.select(F.lit("WIKILINKS.md").alias("file"), F.lit(0).alias("part"), F.col("category").alias("sector"), F.lpad(F.col("rank").cast("string"), 9, "0").alias("ticker"), "line")
    return 1 if args.dry_run else sinks.write_pages(pages, args.out or args.reports)


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    """What the command found or the number of files it wrote."""
    rows = reports.read_reports(spark, args.reports)
    if args.command == "add":
        new = spark.createDataFrame([(args.ticker, args.name, " ".join(args.sector or []) or None)], "ticker string, name string, sector string")
        return put(upsert.new_reports(new, rows), args, by_path=False)
    if args.command == "base-reports":
        return put(upsert.new_reports(reports.read_roster(spark, args.roster, args.rows), rows), args, by_path=False)
    if args.command == "organize":
        return put(upsert.organized(rows), args, by_path=False)
    if args.command == "enrich":
        chosen = scoped(spark, args).of(rows)
        return put(upsert.enrich(chosen, reports.read_payload(spark, args.data)).where("outcome = 'ENRICHED'"), args)
    if args.command == "valuation":
        return put(upsert.update_valuation(scoped(spark, args).of(rows), quotes_of(spark, args)).where("outcome = 'UPDATED'"), args)
    if args.command == "financials":
        made = statements.latest(statements.metrics(statements.line_items(statements.preferred_source(market.read_statements(spark, args.statements), "ticker", market.SOURCES, F.lit(True)))))
        tables = statements.rendered(made).groupBy("ticker").pivot("period_kind", ["A", "Q"]).agg(F.first("table"))
        sections = tables.join(quotes_of(spark, args), "ticker", "left").select("ticker", statements.financial_section(F.col("block"), F.col("A"), F.col("Q")).alias("section"), "market_cap", "enterprise_value")
        return put(upsert.update_financials(scoped(spark, args).of(rows), sections).where("outcome = 'UPDATED'"), args)
    if args.command == "audit":
        found = audit.audit(batches(spark, args).where(F.lit(True) if args.all or args.batch is None else F.col("batch") == args.batch), rows)
        if args.verbose:
            return found.where("status <> 'CLEAN'").orderBy("batch", "ticker")
        return audit.batch_scores(found, "batch").orderBy("batch") if not args.all else audit.overall_score(found)
    if args.command == "discover":
        if args.sector or args.sectors:
            sectors = [" ".join(args.sector)] if args.sector else [s.strip() for s in args.sectors.split(",")]
        else:
            sectors = scope.profile_sectors(scope.profile_of(args.keyword)) if args.smart else None
        found = discover.hits(rows, args.keyword, sectors)
        if args.apply:
            wrote = put(discover.tagged(rows.join(found.select("ticker"), "ticker", "left_semi"), args.keyword).where("applied > 0"), args)
            if args.rebuild:
                rows = reports.read_reports(spark, args.out or args.reports)
                wrote += theme_pages(spark, rows, args) + network_page(spark, rows, args) + index_page(spark, args)
            return wrote
        return found.orderBy("role", "ticker")
    if args.command == "index":
        return index_page(spark, args)
    if args.command == "network":
        return network_page(spark, rows, args, args.min_weight, args.top)
    if args.list:
        return themes.listing(spark, themes.company_counts(themes.entries(rows)))
    return theme_pages(spark, rows, args, args.tag)


def main() -> None:
    args = parser().parse_args()
    out = run(SparkSession.builder.appName("fathomtext").getOrCreate(), args)
    if isinstance(out, DataFrame):
        out.show(1000, truncate=False)
    else:
        print(f"{out} files")


if __name__ == "__main__":
    main()
