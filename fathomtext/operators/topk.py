"""The most frequent names of a corpus that grows day by day, without counting all of it again.

Each day leaves its counts by name and one small sketch of its most frequent names. Sketches are merged; a
name that the merged sketch does not hold occurs at most ``error`` times. So the names it holds
are the candidates, only their daily counts are added up, and if the last of the top k has more
than that many the result is exact. If it has not, the sketch was too small for these data, and
the daily counts of all names are added up instead. No report is read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that a sketch tracks.
TRACKED = 12_288
COUNTS, SKETCHES = "name string, cnt long, day string", "state struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>, n long, day string"


def add(rows: DataFrame, folder: str, tracked: int = TRACKED) -> None:
    """Put some days' names (day, name; a row an occurrence) into the store; a day that is there is replaced. Rows without day or name are left out."""
    rows = rows.select(F.col("day").cast("string").alias("day"), F.col("name").cast("string").alias("name")).dropna()
    made = {
        "counts": rows.groupBy("day", "name").agg(F.count(F.lit(1)).alias("cnt")),
        "sketches": rows.groupBy("day").agg(F.expr(f"approx_top_k_accumulate(name, {tracked})").alias("state"), F.count(F.lit(1)).alias("n")),
    }
    for name, df in made.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/{name}")


def error(n: int, tracked: int = TRACKED) -> float:
    """How often a name at most occurs among n that a sketch of so many names does not hold."""
    size = 1 << (max(1, -(-tracked * 4 // 3)) - 1).bit_length()  # a power of two of which three quarters are used
    return 3.5 * n / size


def merged(spark: SparkSession, folder: str, tracked: int = TRACKED) -> tuple[DataFrame, int]:
    """The candidates (name) that the days' sketches hold together, and the number of occurrences of all days."""
    days = spark.read.schema(SKETCHES).parquet(f"{folder}/sketches")
    n = days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    whole = days.agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state")) if n else None
    if whole is None:
        return spark.createDataFrame([], "name string"), 0
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(state, {tracked})")).alias("x")).select(F.col("x.item").alias("name")), n


def top(spark: SparkSession, folder: str, k: int, tracked: int = TRACKED) -> tuple[DataFrame, bool]:
    """(name, cnt of the k most frequent names with ties by name, whether the sketches sufficed)."""
    counts = spark.read.schema(COUNTS).parquet(f"{folder}/counts")
    order = lambda df: df.groupBy("name").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "name").limit(k)
    candidates, n = merged(spark, folder, tracked)
    found = order(counts.join(F.broadcast(candidates), "name", "left_semi"))  # tracked names at most
    rows, least = found.agg(F.count(F.lit(1)), F.min("cnt")).first()
    if rows == k and least > error(n, tracked) or not n:
        return found, True
    return order(counts), False
