"""Entity co-occurrence graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import vocabulary as V
from .mentions import document_frequency


#: Names of one document, on average, that form a block; pairs are made of two blocks at a time.
BLOCK = 256


def blocks(once: DataFrame, key: str, size: int = BLOCK, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Two frames (key, a, b, name and what is to be carried) whose join on key, a and b gives each pair of a document's names once or, within a block, twice.

    once: key, name, no row twice. A document's names are dealt to blocks by hash, one for each size of
    them; the left frame holds block a and the right one block b of the pairs a <= b. So no join key has many more than size rows a
    side, whatever the document has, and a document of one block is left as it is.
    """
    wide = once.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__k")).where("__k > 1")
    rows = once.join(wide, key, "left").withColumn("__k", F.coalesce("__k", F.lit(1)))
    rows = rows.withColumn("__c", F.pmod(F.xxhash64("name"), F.col("__k")).cast("int"))
    left = rows.select(key, F.col("__c").alias("a"), F.explode(F.sequence("__c", F.col("__k") - 1)).alias("b"), "name", *carry)
    right = rows.select(key, F.explode(F.sequence(F.lit(0), F.col("__c"))).alias("a"), F.col("__c").alias("b"), "name", *carry)
    return left, right


def pairs(once: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """key, source, target (source < target) of all pairs of names of each document, made of pairs of blocks.

    A merge join: both sides hold every name of every document, which Spark's estimate from the size of the files does not see.
    """
    left, right = blocks(once, key, size)
    met = left.withColumnRenamed("name", "x").hint("merge").join(right.withColumnRenamed("name", "y"), [key, "a", "b"])
    return met.where((F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y"))).select(key, F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"))


def edges(rows: DataFrame, key: str, min_weight: int = 5, min_df: int = 2, top: int = 0, size: int = BLOCK) -> DataFrame:
    """source, target, weight: pairs of names (source < target) and the documents that have both.

    rows: key, name, repeated ones allowed. Names in fewer than min_df documents, or with top not
    among the so many most frequent (ties by name), are dropped before pairs are made, so the join
    sees only names that can stand in an edge. Rows without key or name pair with nothing. A document
    with very many names is no task of its own: its pairs are made block by block.
    """
    once = rows.select(key, "name").dropna().distinct()
    freq = document_frequency(once, key)
    nodes = freq.orderBy(F.desc("df"), "name").limit(top) if top else freq.where(F.col("df") >= min_df)
    kept = once.join(nodes.select("name"), "name", "left_semi")
    return pairs(kept, key, size).groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)


def nodes(rows: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """id, count, category, color of the names that stand in an edge."""
    ends = links.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    freq = document_frequency(rows.select(key, "name").dropna(), key)
    category = X.categorize(F.col("name"))
    return freq.join(ends, "name", "left_semi").select(F.col("name").alias("id"), F.col("df").alias("count"), category.alias("category"), X.literal_map(V.CATEGORY_COLORS)[category].alias("color"))


def neighbors(links: DataFrame, name: str) -> DataFrame:
    """neighbor, weight of one name's edges."""
    touching = links.where((F.col("source") == name) | (F.col("target") == name))
    return touching.select(F.when(F.col("source") == name, F.col("target")).otherwise(F.col("source")).alias("neighbor"), "weight")


def neighbor_table(links: DataFrame) -> DataFrame:
    """name, neighbor, weight of every name's edges: each edge from both of its ends."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("target").alias("neighbor")), F.struct(F.col("target").alias("name"), F.col("source").alias("neighbor"))))
    return links.select(ends.alias("e"), "weight").select("e.name", "e.neighbor", "weight")


def search(points: DataFrame, text: str) -> DataFrame:
    """The first node whose name contains the text without regard to case, the most frequent first."""
    return points.where(F.contains(F.lower("id"), F.lower(F.lit(text)))).orderBy(F.desc("count"), "id").limit(1)


def scaled(points: DataFrame) -> DataFrame:
    """Nodes with radius: 4 to 40 by the square root of the count."""
    most = points.agg(F.max("count").alias("most"))
    return points.crossJoin(F.broadcast(most)).withColumn("radius", F.when(F.col("most") > 1, 4 + 36 * (F.sqrt("count") - 1) / (F.sqrt("most") - 1)).otherwise(4.0)).drop("most")


def scaled_edges(links: DataFrame) -> DataFrame:
    """Edges with width 0.5 to 4 and opacity 0.15 to 0.6 by weight."""
    ends = links.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    share = F.coalesce(F.try_divide(F.col("weight") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return links.crossJoin(F.broadcast(ends)).select("source", "target", "weight", (0.5 + 3.5 * share).alias("width"), (0.15 + 0.45 * share).alias("opacity"))
