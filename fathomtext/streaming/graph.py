"""The co-occurrence graph over a stream of reports that are added, replaced and withdrawn.

A stateful operator keeps each report's names. A new version of a report is compared with them and
gives one row for each of its names: added, taken away or still there. From these rows come the
pairs that the report has gained (+1) or lost (-1), block by block, as in the batch graph; no report is
read again that has not changed. Each micro-batch stores its changes under its number, so one
that is run twice changes nothing, and the graph is the sum of base and changes; ``compact`` makes a new base.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text as X
from ..operators import network
from ..sources import manifest

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "ticker string, name string, change int"


class ReportNames(StatefulProcessor):
    """Of each ticker the version and names of its newest report."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("report", "version long, names array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        newest = max(rows, key=lambda r: (r["version"], r["names"] or []))
        version, old = self.held.get() or (None, [])
        if version is not None and newest["version"] < version:
            return
        old, new = set(old or []), set(newest["names"] or [])
        self.held.update((newest["version"], sorted(new)))
        if old != new:
            for name in sorted(old | new):
                yield Row(ticker=key[0], name=name, change=(name in new) - (name in old))

    def close(self) -> None:
        pass


def changes(reports: DataFrame) -> DataFrame:
    """ticker, name, change (1 added, 0 kept, -1 gone) of each report whose names changed. reports: a stream of ticker, version, content.

    The largest version of a ticker counts, of equal ones the last to arrive; older ones that arrive late change
    nothing. A null content withdraws the report. Rows without a ticker or version are left out.
    """
    names = F.array_distinct(X.links(X.before_financials(F.col("content"))))
    rows = reports.where("ticker is not null and version is not null").select("ticker", F.col("version").cast("long").alias("version"), names.alias("names"))
    return rows.groupBy("ticker").transformWithState(ReportNames(), CHANGES, "Append", "None")


def pair_changes(rows: DataFrame) -> DataFrame:
    """source, target, change: how many documents more or fewer have both. rows: what changes() gives of one micro-batch."""
    left, right = network.blocks(rows, "ticker", carry=("change",))
    met = left.withColumnsRenamed({"name": "x", "change": "p"}).hint("merge").join(right.withColumnsRenamed({"name": "y", "change": "q"}), ["ticker", "a", "b"])
    met = met.where((F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    gained, lost = (F.least("p", "q") >= 0) & (F.greatest("p", "q") > 0), (F.greatest("p", "q") <= 0) & (F.least("p", "q") < 0)
    signed = met.select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), F.when(gained, 1).when(lost, -1).alias("change")).where("change is not null")
    return signed.groupBy("source", "target").agg(F.sum("change").alias("change")).where("change <> 0")


def stream_edges(reports: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the graph in folder up to date with a stream of reports; once: stop when all that is there has been read.

    The names that a micro-batch changes are stored before pairs are made of them: pairs read them several times, and
    each reading would run the stateful operator again.
    """
    spark = reports.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(names := f"{folder}/names/batch={batch}")
        pair_changes(spark.read.schema(CHANGES).parquet(names)).write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")
        store, root = manifest.opened(folder)
        store.delete_dir(f"{root}/names/batch={batch}")

    writer = changes(reports).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(keep)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """source, target, weight of all pairs, with the last micro-batch in them."""
    _, state = manifest.read(folder)
    schema = "source string, target string, change long, batch long"
    store, root = manifest.opened(folder)
    there = store.get_file_info(f"{root}/changes").type == manifest.fs.FileType.Directory
    rows = spark.read.schema(schema).parquet(f"{folder}/changes") if there else spark.createDataFrame([], schema)
    rows = rows.where(F.col("batch") > state.get("batch", -1))
    last = rows.agg(F.max("batch")).first()[0]
    rows = rows.select("source", "target", "change")
    if state:
        rows = rows.unionByName(spark.read.parquet(state["base"]).select("source", "target", F.col("weight").alias("change")))
    weight = F.sum("change").alias("weight")
    return rows.groupBy("source", "target").agg(weight).where("weight <> 0"), state.get("batch", -1) if last is None else last


def edges(spark: SparkSession, folder: str, min_weight: int = 5) -> DataFrame:
    """source, target, weight, as network.edges over the newest reports with min_df of at most min_weight."""
    return stored_pairs(spark, folder)[0].where(F.col("weight") >= min_weight)


def compact(spark: SparkSession, folder: str) -> None:
    """Sum up what is there into a new base; the changes in it are deleted once the new base counts."""
    version, state = manifest.read(folder)
    rows, batch = stored_pairs(spark, folder)
    if batch == state.get("batch", -1):
        return
    base = manifest.fresh(folder, "pairs")
    rows.write.parquet(base)
    manifest.swap(folder, version, {"base": base, "batch": batch})
    store, root = manifest.opened(folder)
    for x in store.get_file_info(manifest.fs.FileSelector(f"{root}/changes")):
        if x.base_name.startswith("batch=") and int(x.base_name[6:]) <= batch:
            store.delete_dir(x.path)
    manifest.vacuum(folder, {base})
