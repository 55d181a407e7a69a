"""Mentions of entities: extraction, counting, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def mentions(docs: DataFrame, names: Column, *keys: str) -> DataFrame:
    """One row per occurrence: the keys and name. names: an array of names for each document."""
    return docs.select(*keys, F.explode(names).alias("name"))


def report_mentions(reports: DataFrame, whole: bool = False) -> DataFrame:
    """Linked names of reports, of the whole file or of what stands before the financial section."""
    text = F.col("content") if whole else X.before_financials(F.col("content"))
    return mentions(reports, X.links(text), "ticker")


def bag_counts(rows: DataFrame) -> DataFrame:
    """Occurrences of each name."""
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("cnt"))


def document_frequency(rows: DataFrame, key: str, at_least: int = 1) -> DataFrame:
    """Documents that have each name."""
    return rows.select(key, "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= at_least)


def index(counts: DataFrame, category: Column | None = None, listed: Column | None = None, least: int = 2) -> DataFrame:
    """name, category, cnt: listed terms from one occurrence on, others from least on."""
    category = X.categorize_for_index(F.col("name")) if category is None else category
    rows = counts.withColumn("category", category)
    listed = F.col("category").isin("technology", "material", "application") if listed is None else listed
    return rows.where(listed | (F.col("cnt") >= least)).select("name", "category", "cnt")


def top_of_each_category(rows: DataFrame, limits: dict[str, int] | int | None) -> DataFrame:
    """name, category, cnt, rank, total: the most frequent names of each category, ties by name; total counts all."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("cnt"), "name"))
    if isinstance(limits, dict):
        most = F.coalesce(F.create_map(*(F.lit(x) for p in limits.items() for x in p))[F.col("category")], F.lit(2**31 - 1))
    else:
        most = F.lit(2**31 - 1 if limits is None else limits)
    totals = rows.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    ranked = rows.withColumn("rank", rank)
    # A plain number lets Spark drop rows before the exchange.
    bound = limits if isinstance(limits, int) else max(limits.values(), default=0) if isinstance(limits, dict) else None
    if isinstance(limits, dict) and any(True for _ in limits):
        open_ended = rows.where(~F.col("category").isin(*limits)).withColumn("rank", rank)
        ranked = rows.where(F.col("category").isin(*limits)).withColumn("rank", rank).where(F.col("rank") <= bound).unionByName(open_ended)
    kept = ranked.where(F.col("rank") <= bound) if isinstance(limits, int) else ranked.where(F.col("rank") <= most)
    return kept.join(F.broadcast(totals), "category").select("name", "category", "cnt", F.col("rank").cast("long").alias("rank"), "total")


def totals(counts: DataFrame, category: Column | None = None, least: int = 2) -> DataFrame:
    """names, listed, mentions: all distinct names, those that the index lists, and all occurrences; omitted single ones count in the first and last."""
    category = X.categorize_for_index(F.col("name")) if category is None else category
    listed = category.isin("technology", "material", "application") | (F.col("cnt") >= least)
    return counts.agg(F.count(F.lit(1)).alias("names"), F.count_if(listed).alias("listed"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("mentions"))
