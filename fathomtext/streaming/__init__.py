"""Incremental refresh of mention counts and of the graph (extensions: the corpus tools only rebuild in full)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X

COUNTS = "name string, cnt long, batch long"


def stream_mentions(reports: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep counts of links over a stream of new reports (content) in a folder that all executors share.

    Each micro-batch stores its own counts under its number, so one that is run twice counts once; once: stop when all
    that is there has been read. Reports that replace others belong in streaming.graph.
    """

    def store(rows: DataFrame, batch: int) -> None:
        counts = rows.select(F.explode(X.links(F.col("content"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("cnt"))
        counts.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = reports.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer).start()


def mention_counts(spark: SparkSession, folder: str) -> DataFrame:
    """name, cnt over all micro-batches so far."""
    return spark.read.schema(COUNTS).parquet(folder).groupBy("name").agg(F.sum("cnt").alias("cnt"))
