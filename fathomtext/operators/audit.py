"""Rule-based quality audit of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import vocabulary as V


def none() -> Column:
    return F.array().cast("array<string>")


def when_list(condition: Column, issue: Column) -> Column:
    return F.when(condition, F.array(issue)).otherwise(none())


def placeholders(text: Column) -> Column:
    return F.concat(*(when_list(F.contains(text, F.lit(p)), F.lit(f"Placeholder found: '{p}'")) for p in V.PLACEHOLDERS))


def english(every: Column) -> Column:
    """The first indicator, by line and then by list, in the first lines (of all that are given) that hold no label."""
    lines = F.filter(F.slice(every, 1, V.ENGLISH_LINES), lambda x: ~F.contains(x, F.lit("**")) & ~F.contains(x, F.lit(":")))
    first = lambda line: F.coalesce(*(F.when(F.contains(line, F.lit(i)), F.lit(i)) for i in V.ENGLISH_INDICATORS))
    found = F.get(F.filter(F.transform(lines, first), lambda x: x.isNotNull()), F.lit(0))
    return X.let(found, lambda i: when_list(i.isNotNull(), F.concat(F.lit("English text detected: '"), i, F.lit("'"))))


def missing_sections(text: Column) -> Column:
    return F.concat(*(when_list(~F.contains(text, F.lit(s)), F.lit(f"Missing section: {s}")) for s in V.SECTIONS))


def metadata(text: Column, every: Column) -> Column:
    """Of each field whether its label is missing, or its first line (of all that are given) has no value."""

    def valued(line: Column, field: str) -> Column:
        rest = X.strip(F.substr(line, F.position(F.lit(field), line) + len(field)))
        empty = (F.length(rest) == 0) | F.contains(line, F.lit(V.NOT_FILLED))
        return F.when(empty, F.array(F.lit(f"Empty metadata: {field}"))).otherwise(none())

    def one(field: str) -> Column:
        line = F.get(F.filter(every, lambda x: F.contains(x, F.lit(field))), F.lit(0))
        return F.when(~F.contains(text, F.lit(field)), F.array(F.lit(f"Missing metadata: {field}"))).otherwise(X.let(line, lambda x: valued(x, field)))

    return F.concat(*(one(f) for f in V.METADATA))


def link_rules(text: Column) -> Column:
    few = lambda found: when_list(F.size(found) < V.MIN_LINKS, F.concat(F.lit("Only "), F.size(found).cast("string"), F.lit(f" wikilinks (minimum {V.MIN_LINKS})")))
    named = lambda generic: F.concat(F.lit("["), F.array_join(F.transform(generic, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    marked = lambda generic: when_list(F.size(generic) > 0, F.concat(F.lit("Generic wikilinks ("), F.size(generic).cast("string"), F.lit("): "), named(generic)))
    is_generic = lambda x: F.coalesce(*(F.when(F.contains(x, F.lit(m)), F.lit(True)) for m in V.GENERIC_MARKERS), F.lit(False))
    return X.let(X.links(text), lambda found: F.concat(few(found), X.let(F.filter(found, is_generic), marked)))


def thin(text: Column) -> Column:
    def few(least: int, label: str):
        return lambda n: when_list(n < least, F.concat(F.lit(f"{label} too thin ("), n.cast("string"), F.lit(" lines)")))

    out = []
    for header, following, least, label in ((V.SUPPLY_CHAIN, V.CUSTOMERS, V.MIN_CHAIN_LINES, "Supply chain"), (V.CUSTOMERS, V.FINANCIALS, V.MIN_CUSTOMER_LINES, "Customers/suppliers")):
        body = F.regexp_extract(text, rf"(?s){X.quoted(header)}\n(.*?)(?=\n{X.quoted(following)}|\z)", 1)
        n = F.size(F.filter(F.split(body, "\n", -1), lambda x: F.length(X.strip(x)) > 0))
        out.append(F.when(F.contains(text, F.lit(header + "\n")), X.let(n, few(least, label))).otherwise(none()))
    return F.concat(*out)


def issues(text: Column) -> Column:
    """All issues in order; a text that is too short has only that one."""
    lined = X.let(F.split(text, "\n", -1), lambda every: F.array(english(every), metadata(text, every)))
    rest = F.concat(placeholders(text), X.let(lined, lambda x: F.concat(x[0], missing_sections(text), x[1])), link_rules(text), thin(text))
    return F.when(F.length(text) < V.MIN_CHARS, F.array(F.lit(f"Content too short (<{V.MIN_CHARS} chars)"))).otherwise(rest)


def status(found: Column) -> Column:
    """MISSING (no report), CLEAN, NEEDS ENRICHMENT or NEEDS QUALITY FIX."""
    raw = F.exists(found, lambda i: F.startswith(i, F.lit("Placeholder")) | F.startswith(i, F.lit("English")) | F.startswith(i, F.lit("Content too short")))
    return F.when(found.isNull(), "MISSING").when(F.size(found) == 0, "CLEAN").when(raw, "NEEDS ENRICHMENT").otherwise("NEEDS QUALITY FIX")


def audit(batches: DataFrame, reports: DataFrame) -> DataFrame:
    """batch, ticker, status, issues for every ticker of the batches; a null content counts as unreadable and needs enrichment.

    A report's issues are the one row of a generator, behind which no filter on them is pushed; so they are found once.
    """
    found = F.when(F.col("content").isNull(), F.array(F.lit("Content too short (<200 chars)"))).otherwise(issues(F.col("content")))
    seen = reports.select("ticker", F.explode(F.array(found)).alias("issues"))
    wanted = batches.select("batch", F.explode("tickers").alias("ticker"))
    return wanted.join(seen, "ticker", "left").select("batch", "ticker", status(F.col("issues")).alias("status"), "issues")


def batch_scores(rows: DataFrame, *groups: str) -> DataFrame:
    """total, clean, enrichment, quality, missing, pct: missing ones count in the total."""
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"), n("CLEAN").alias("clean"), n("NEEDS ENRICHMENT").alias("enrichment"), n("NEEDS QUALITY FIX").alias("quality"), n("MISSING").alias("missing")).withColumn(
        "pct", F.coalesce(F.try_divide(F.col("clean"), F.col("total")) * 100, F.lit(0.0)))


def overall_score(rows: DataFrame) -> DataFrame:
    """total, clean, pct over all batches: missing ones do not count."""
    return rows.where(F.col("status") != "MISSING").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "CLEAN").alias("clean")).withColumn("pct", F.coalesce(F.try_divide(F.col("clean"), F.col("total")) * 100, F.lit(0.0)))
