"""Readers of report folders, checklists, payloads and rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import PAYLOAD
from . import folder
from .sheets import SheetSource

NAMED = r"^(\d{4})_(.+)\.md$"


def report_paths(spark: SparkSession, root: str, pattern: str = NAMED, recursive: bool = True, tree: str | None = None) -> DataFrame:
    """ticker, path of the Markdown files whose name fits, of a ticker's files the last path; their contents are not read.

    tree: a pattern whose group names the collection that a path belongs to, if the folder holds several; a ticker then counts once in each.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = folder.paths(spark, root, recursive).where(name.rlike(pattern)).select(F.regexp_extract(name, r"^(\d{4})", 1).alias("ticker"), "path")
    groups = ["ticker"] if tree is None else ["ticker", F.regexp_extract("path", tree, 1).alias("tree")]
    return rows.groupBy(*groups).agg(F.max("path").alias("path")).select("ticker", "path")


def read_reports(spark: SparkSession, root: str, pattern: str = NAMED, recursive: bool = True, tree: str | None = None) -> DataFrame:
    """ticker, company, sector, path, content of the Markdown files whose name fits; of a ticker's files (in each tree) the last path counts."""
    rows = folder.texts(spark, root, recursive, report_paths(spark, root, pattern, recursive, tree))
    parts = F.split("path", "/")
    return rows.select(F.regexp_extract(F.element_at(parts, -1), r"^(\d{4})", 1).alias("ticker"), F.nullif(F.regexp_extract(F.element_at(parts, -1), NAMED, 2), F.lit("")).alias("company"), F.element_at(parts, -2).alias("sector"), "path", "content")


def read_all_markdown(spark: SparkSession, root: str) -> DataFrame:
    """path, content of every Markdown file, whatever its name."""
    return folder.texts(spark, root)


def read_checklist(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) that operators.scope.parse_batches takes."""
    return spark.read.text(path)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """ticker, data of a JSON object keyed by ticker."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", PAYLOAD)).alias("ticker", "data"))


def read_roster(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """ticker, name of a headerless table, a spreadsheet (.xlsx) or CSV; a name that is missing is "Unknown"."""
    if path.endswith(".xlsx"):
        spark.dataSource.register(SheetSource)
        got = spark.read.format("sheet").schema("ticker string, name string").load(path).select(F.trim("ticker").alias("ticker"), F.trim("name").alias("name"))
    else:
        got = spark.read.csv(path, header=False, schema="ticker string, name string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    got = got.where("ticker is not null").withColumn("name", F.coalesce("name", F.lit("Unknown")))
    return got if rows is None else got.limit(rows)
