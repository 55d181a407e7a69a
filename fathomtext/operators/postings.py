"""A stored inverted index of theme entries: screens, counts and neighbours without reading reports.

Reports are numbered in the order of their tickers. A posting row holds the reports of one tag within one
stretch of SPAN numbers: each as its distance from the stretch's start (two bytes), sorted, with its role, and
how many there are of each role. Rows are laid out by a hash of the tag and sorted, so that a few tags open
a few files and in them a few row groups. Beside them stand a term dictionary, the reports by
number and each report's tags. A manifest names the four tables, so a new index takes the old one's place at once.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import vocabulary as V
from ..sources import manifest
from .order import placed

#: Numbers that one posting row covers at most, and folders that postings are laid out in.
SPAN, BUCKETS = 1 << 15, 16
ROLES = list(V.ROLE_LABELS)
_counts = "".join(f", {r} long" for r in ROLES)
SCHEMAS = {
    "docs": "ticker string, company string, sector string, doc long", "terms": f"tag string, companies long{_counts}", "forward": "doc long, tags array<string>",
    "postings": f"tag string, span long, n int{_counts}, at array<smallint>, role array<tinyint>, bucket int",
}


def bucket(tag: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(tag.encode()) % buckets


def build(entries: DataFrame, folder: str, buckets: int = BUCKETS) -> int:
    """Store the index of entries (tag, ticker, company, sector, role, as themes.entries gives them; a ticker once in a tag); returns its version."""
    spark = entries.sparkSession
    version, _ = manifest.read(folder)
    docs, postings, terms, forward, *once_made = (manifest.fresh(folder, n) for n in ("docs", "postings", "terms", "forward", "entries", "named", "numbered"))

    def kept(df: DataFrame, path: str) -> DataFrame:
        """What is read several times below, made once; gone with the vacuum."""
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    entries = kept(entries.select("tag", "ticker", "company", "sector", "role"), once_made[0])
    once = entries.groupBy("ticker").agg(F.first("company").alias("company"), F.first("sector").alias("sector"))
    placed(kept(once, once_made[1]), "ticker", name="doc").withColumn("doc", F.col("doc") - 1).write.parquet(docs)
    rows = entries.join(spark.read.schema(SCHEMAS["docs"]).parquet(docs).select("ticker", "doc"), "ticker").select("tag", "doc", F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("byte").alias("role"))
    rows = kept(rows, once_made[2])
    span = F.floor(F.col("doc") / SPAN)
    list_ = F.sort_array(F.collect_list(F.struct((F.col("doc") % SPAN).cast("short").alias("at"), "role")))  # SPAN of them at most
    counts = [F.count_if(F.col("role") == i + 1).alias(r) for i, r in enumerate(ROLES)]
    made = rows.groupBy("tag", span.alias("span")).agg(list_.alias("l"), *counts)
    made = made.select("tag", "span", F.size("l").alias("n"), *ROLES, F.transform("l", lambda x: x["at"]).alias("at"), F.transform("l", lambda x: x["role"]).alias("role"), (F.crc32(F.col("tag").cast("binary")) % buckets).cast("int").alias("bucket"))
    made.repartition("bucket").sortWithinPartitions("bucket", "tag", "span").write.partitionBy("bucket").parquet(postings)
    spark.read.schema(SCHEMAS["postings"]).parquet(postings).groupBy("tag").agg(F.sum("n").alias("companies"), *(F.sum(r).alias(r) for r in ROLES)).orderBy("tag").write.parquet(terms)
    rows.groupBy("doc").agg(F.sort_array(F.collect_list("tag")).alias("tags")).repartitionByRange("doc").sortWithinPartitions("doc").write.parquet(forward)
    state = {"docs": docs, "postings": postings, "terms": terms, "forward": forward, "buckets": buckets}
    done = manifest.swap(folder, version, state)
    manifest.vacuum(folder, {docs, postings, terms, forward})
    return done


def part(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(manifest.read(folder)[1][name])


def postings_of(spark: SparkSession, folder: str, tags: list[str] | None) -> DataFrame:
    """The posting rows of some tags (all if None): only their folders and row groups are read."""
    _, state = manifest.read(folder)
    rows = spark.read.schema(SCHEMAS["postings"]).parquet(state["postings"])
    return rows if tags is None else rows.where(F.col("bucket").isin(sorted({bucket(t, state["buckets"]) for t in tags})) & F.col("tag").isin(tags))


def numbers(rows: DataFrame) -> DataFrame:
    """tag, doc, role of posting rows, spelled out."""
    x = F.explode(F.arrays_zip("at", "role")).alias("x")
    role: Column = F.element_at(F.array(*map(F.lit, ROLES)), F.col("x.role").cast("int"))
    return rows.select("tag", "span", x).select("tag", (F.col("span") * SPAN + F.col("x.at")).alias("doc"), role.alias("role"))


def screen(spark: SparkSession, folder: str, tags: list[str] | None = None) -> DataFrame:
    """tag, ticker, company, sector, role of the companies of some tags, as the entries had them."""
    return numbers(postings_of(spark, folder, tags)).join(part(spark, folder, "docs"), "doc").select("tag", "ticker", "company", "sector", "role")


def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    """tag, companies and the companies in each role, from the dictionary alone."""
    return part(spark, folder, "terms")


def both(spark: SparkSession, folder: str, one: str, other: str) -> DataFrame:
    """ticker of the companies of two tags: two posting lists that meet stretch by stretch."""
    rows = postings_of(spark, folder, [one, other])
    side = lambda t, c: rows.where(F.col("tag") == t).select("span", F.col("at").alias(c))
    met = side(one, "x").join(side(other, "y"), "span").select("span", F.explode(F.array_intersect("x", "y")).alias("at"))
    return met.select((F.col("span") * SPAN + F.col("at")).alias("doc")).join(part(spark, folder, "docs"), "doc").select("ticker")


def neighbors(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    """neighbor, weight: the tags that stand in reports with a tag, and in how many; only these reports' tags are read."""
    own = numbers(postings_of(spark, folder, [tag])).select("doc")
    tags = part(spark, folder, "forward").join(own, "doc", "left_semi").select(F.explode("tags").alias("neighbor"))
    return tags.where(F.col("neighbor") != tag).groupBy("neighbor").agg(F.count(F.lit(1)).alias("weight"))
