"""Keyed updates of reports: enrichment, figures, new reports. Each returns new rows; sinks write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import vocabulary as V

PAYLOAD = "map<string, struct<desc: string, supply_chain: string, cust: string, sector: string, industry: string>>"


def enriched_text(text: Column, payload: Column) -> Column:
    """Sections that the payload has are replaced, a missing metadata block is put in, links are normalised."""
    n_a = lambda c: F.coalesce(c, F.lit("N/A"))
    meta = F.concat(F.lit("**板塊:** "), n_a(payload["sector"]), F.lit("\n**產業:** "), n_a(payload["industry"]), F.lit(f"\n**市值:** N/A {V.UNIT}\n**企業價值:** N/A {V.UNIT}\n\n"))
    head = V.BUSINESS + "\n"
    bare = ~F.contains(text, F.lit("**板塊:**")) & ~F.contains(text, F.lit("**市值:**"))
    text = F.when(bare & F.contains(text, F.lit(head)), F.concat(F.substring_index(text, head, 1), F.lit(head), meta, F.substr(text, F.position(F.lit(head), text) + len(head)))).otherwise(text)
    described = F.regexp_replace(text, F.lit(rf"(?s)({V.BUSINESS}\n(?:.*?企業價值:.*?\n\n|))(.*?)(?=\n{V.SUPPLY_CHAIN})"), F.concat(F.lit("$1"), X.replacement(payload["desc"]), F.lit("\n")))
    text = F.when(payload["desc"].isNotNull(), described).otherwise(text)
    for field, header, following in (("supply_chain", V.SUPPLY_CHAIN, V.CUSTOMERS), ("cust", V.CUSTOMERS, V.FINANCIALS)):
        text = F.when(payload[field].isNotNull(), X.replace_section(text, header, payload[field], following)).otherwise(text)
    return X.normalize_links(text)


def enrich(reports: DataFrame, payload: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """All reports, those with a payload rewritten; outcome is ENRICHED or KEPT. An empty list of tickers means all.

    payload: ticker, data (struct). Of repeated tickers any one payload counts; payloads without a
    report have no row, see unmatched().
    """
    chosen = payload.where(F.col("ticker").isin(*tickers)) if tickers else payload
    chosen = chosen.dropDuplicates(["ticker"]).select("ticker", F.col("data").alias("__data"))
    joined = reports.join(chosen, "ticker", "left")
    return joined.withColumns({"content": F.when(F.col("__data").isNotNull(), enriched_text(F.col("content"), F.col("__data"))).otherwise(F.col("content")), "outcome": F.when(F.col("__data").isNotNull(), "ENRICHED").otherwise("KEPT")}).drop("__data")


def unmatched(payload: DataFrame, reports: DataFrame) -> DataFrame:
    """Payload tickers without a report."""
    return payload.select("ticker").distinct().join(reports.select("ticker"), "ticker", "left_anti")


def update_financials(reports: DataFrame, sections: DataFrame) -> DataFrame:
    """Reports with the financial section and figures of sections (ticker, section, market_cap, enterprise_value); outcome UPDATED or SKIPPED."""
    joined = reports.join(sections, "ticker", "left")
    new = X.patch_metadata(X.replace_financials(F.col("content"), F.col("section")), F.col("market_cap"), F.col("enterprise_value"))
    return joined.withColumns({"content": F.when(F.col("section").isNotNull(), new).otherwise(F.col("content")), "outcome": F.when(F.col("section").isNotNull(), "UPDATED").otherwise("SKIPPED")}).drop("section", "market_cap", "enterprise_value")


def update_valuation(reports: DataFrame, values: DataFrame) -> DataFrame:
    """Reports with the valuation block and figures of values (ticker, block, market_cap, enterprise_value); outcome UPDATED or SKIPPED."""
    joined = reports.join(values.select("ticker", "block", "market_cap", "enterprise_value"), "ticker", "left")
    new = X.patch_metadata(X.replace_valuation(F.col("content"), F.col("block")), F.col("market_cap"), F.col("enterprise_value"))
    return joined.withColumns({"content": F.when(F.col("block").isNotNull(), new).otherwise(F.col("content")), "outcome": F.when(F.col("block").isNotNull(), "UPDATED").otherwise("SKIPPED")}).drop("block", "market_cap", "enterprise_value")


def tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def new_reports(roster: DataFrame, existing: DataFrame, sections: DataFrame | None = None, key: str = "ticker", carry: tuple[str, ...] = ()) -> DataFrame:
    """ticker, company, sector, content of roster rows (ticker, name, and sector, industry if known) whose ticker has no report yet.

    key: what tells companies apart where several have one ticker; carry: columns of the roster to keep.
    """
    rows = roster.join(existing.select(key), key, "left_anti")
    for c in ("sector", "industry"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.join(sections, "ticker", "left") if sections is not None else rows.withColumns({c: F.lit(None).cast("string") for c in ("section", "market_cap", "enterprise_value")})
    known = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    none = f"{V.FINANCIAL_TITLE}\n{V.ANNUAL_TITLE}\n{V.NO_DATA}\n\n{V.QUARTERLY_TITLE}\n{V.NO_DATA}\n"
    name = F.coalesce("name", F.lit("Unknown"))
    content = F.concat(
        F.lit("# "), F.col("ticker"), F.lit(" - [["), name, F.lit(f"]]\n\n{V.BUSINESS}\n**板塊:** "), known("sector", "Unknown"), F.lit("\n**產業:** "), known("industry", "Unknown"),
        F.lit("\n**市值:** "), known("market_cap", "N/A"), F.lit(f" {V.UNIT}\n**企業價值:** "), known("enterprise_value", "N/A"),
        F.lit(f" {V.UNIT}\n\n{V.TO_ENRICH_BUSINESS}\n\n{V.SUPPLY_CHAIN}\n{V.TO_ENRICH}\n\n{V.CUSTOMERS}\n{V.TO_ENRICH}\n\n"), known("section", none))
    return rows.select("ticker", name.alias("company"), X.folder_name(known("sector", "Unknown")).alias("sector"), content.alias("content"), *carry)


def organized(reports: DataFrame) -> DataFrame:
    """Reports with the sector taken from their industry line, without line or value "Uncategorized"."""
    industry = X.industry_line(F.col("content"))
    usable = industry.isNotNull() & (industry != "N/A")
    return reports.withColumn("sector", F.when(usable, X.folder_name(F.replace(industry, F.lit("/"), F.lit("_")))).otherwise("Uncategorized"))
