"""Theme screens: which companies mention a theme, and in which role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import vocabulary as V


def entries(reports: DataFrame, section_mode: str = "compat") -> DataFrame:
    """tag, ticker, company, sector, role: each linked name of a report's first three sections, once.

    compat ends a section at the first heading of any level, as the published pages do; h2 ends it
    at the next H2 heading.
    """
    body = (lambda h: X.split_section(F.col("content"), h.removeprefix("## "))) if section_mode == "compat" else (lambda h: F.coalesce(X.h2_body(F.col("content"), h), F.lit("")))
    chain = body(V.SUPPLY_CHAIN)
    found = reports.select("ticker", "company", "sector", chain.alias("chain"), F.concat(body(V.BUSINESS), F.lit("\n"), chain, F.lit("\n"), body(V.CUSTOMERS)).alias("text"))
    rows = found.select("ticker", "company", "sector", "chain", F.explode(F.array_distinct(X.links(F.col("text")))).alias("tag"))
    return rows.select("tag", "ticker", "company", "sector", X.positional_role(F.col("chain"), F.col("tag")).alias("role"))


def theme_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, n, d, r) for t, (n, d, r) in V.THEMES.items()], "tag string, name string, description string, related array<string>")


def index_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i, t) for i, (c, ts) in enumerate(V.THEME_INDEX.items()) for t in ts], "category string, ord int, tag string")


def screen(rows: DataFrame, themes: DataFrame) -> DataFrame:
    """Entries of defined themes; a theme without entries has no rows."""
    return rows.join(F.broadcast(themes.select("tag", "name")), "tag")


def role_counts(rows: DataFrame, *groups: str) -> DataFrame:
    return rows.groupBy("role", *groups).agg(F.count(F.lit(1)).alias("cnt"))


def company_counts(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """tag, companies of the tags of a small table (all if None); entries of other tags go before companies are told apart."""
    rows = rows.select("tag", "ticker")
    if of is not None:
        rows = rows.join(F.broadcast(of.select("tag")), "tag", "left_semi")
    return rows.groupBy("tag").agg(F.count_distinct("ticker").alias("companies"))


def related(themes: DataFrame, counts: DataFrame) -> DataFrame:
    """tag, related, cnt of related tags that some company mentions. counts: tag, cnt."""
    pairs = themes.select("tag", F.explode("related").alias("related"))
    return F.broadcast(pairs).join(counts.withColumnRenamed("tag", "related"), "related").where("cnt > 0").select("tag", "related", "cnt")


def theme_index(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """category, ord, tag, companies of all themes with companies, whatever subset is rendered."""
    return F.broadcast(index_table(spark)).join(counts, "tag").select("category", "ord", "tag", "companies")


def listing(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """tag, name, description, companies of all defined themes in their order; those without companies have 0."""
    order = spark.createDataFrame([(i, t) for i, t in enumerate(V.THEMES)], "ord int, tag string")
    rows = theme_table(spark).join(order, "tag").join(counts, "tag", "left")
    return rows.select("ord", "tag", "name", "description", F.coalesce("companies", F.lit(0)).cast("long").alias("companies")).orderBy("ord").drop("ord")
