"""Keyword discovery: who mentions a word, linked or not, where and in which words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .order import placed
from .scope import in_sectors


def hits(reports: DataFrame, keyword: str, sectors: list[str] | None = None) -> DataFrame:
    """ticker, company, sector, linked, bare, role, contexts of reports with the keyword before the financial section."""
    head = X.before_financials(F.col("content"))
    rows = in_sectors(reports, sectors).where(F.contains(F.col("content"), F.lit(keyword))).select(
        "ticker", "company", "sector",
        X.occurrences(head, X.linked_pattern(keyword)).alias("linked"), X.occurrences(head, X.bare_pattern(keyword)).alias("bare"),
        X.section_role(head, keyword).alias("role"), X.snippets(head, keyword).alias("contexts"))
    return rows.where("linked + bare > 0")


#: Characters that are searched for all keywords at once.
STRETCH = 8192


def found_keywords(text: Column, keywords: Column, lengths: list[int], stretch: int = STRETCH) -> Column:
    """Those of an array of keywords, whose lengths are given, that a text has, in time that grows with the text and the lengths.

    The text is cut into stretches, each with as much of what follows as the longest keyword takes; of a
    stretch all substrings of these lengths are met with the keywords by hash. Half a character beyond
    the basic plane may be found too, as a question mark.
    """
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{stretch + max(lengths) - 1}}})).{{1,{stretch}}}"), F.lit(1))
    every = lambda part: F.flatten(F.array(*(F.regexp_extract_all(part, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths)))
    return F.array_distinct(F.flatten(F.transform(parts, lambda part: F.array_intersect(every(part), keywords))))


def hits_of_many(reports: DataFrame, keywords: DataFrame, sectors: list[str] | None = None) -> DataFrame:
    """keyword and the columns of hits(), for each keyword (a column of that name; nulls, empty and repeated ones left out), from one scan of the reports.

    Each keyword is looked for on its own, so one inside another is found as hits() finds it. The keywords
    are sent to every task; they are what a user asks for, not data.
    """
    asked = keywords.where("keyword <> ''").select("keyword").distinct()
    lengths = sorted(r[0] for r in asked.select(F.length("keyword").alias("n")).distinct().collect())
    if not lengths:
        return hits(reports.limit(0), "x").select(F.lit("").alias("keyword"), "*")
    every = asked.agg(F.collect_list("keyword").alias("__all"))
    head, k = F.col("__head"), F.col("keyword")
    rows = in_sectors(reports, sectors).join(F.broadcast(every)).withColumn("__head", X.before_financials(F.col("content")))
    rows = rows.select("ticker", "company", "sector", "__head", F.explode(found_keywords(head, F.col("__all"), lengths)).alias("keyword"))
    bare = X.pattern_of(k, X.bare_pattern)
    found = rows.select(
        "keyword", "ticker", "company", "sector", X.occurrences(head, X.pattern_of(k, X.linked_pattern)).alias("linked"), X.occurrences(head, bare).alias("bare"),
        X.section_role(head, k).alias("role"), X.snippets(head, k, bare).alias("contexts"))
    return found.where("linked + bare > 0")


def role_summary(found: DataFrame) -> DataFrame:
    """role, docs, linked_docs, unlinked_docs, bare."""
    return found.groupBy("role").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("linked") > 0).alias("linked_docs"), F.count_if((F.col("bare") > 0) & (F.col("linked") == 0)).alias("unlinked_docs"), F.sum("bare").alias("bare"))


def tagged(reports: DataFrame, keyword: str) -> DataFrame:
    """Reports with taggable occurrences turned into links, and their number (applied)."""
    text, n = X.tag_keyword(F.col("content"), keyword)
    return reports.withColumns({"applied": n, "content": text})


def listing(found: DataFrame) -> DataFrame:
    """Hits with their place in the order by role and ticker."""
    return placed(found, "role", "ticker")
