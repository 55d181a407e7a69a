"""Reports as a table by sector of which an update rewrites the touched sectors only.

The manifest names one data folder for each sector. ``merge`` finds the sectors that changed reports
come from and go to, reads those, writes them anew and swaps the manifest; all other folders stay
as they are, files and times included, and the table may be read while it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest

REPORT = "ticker string, company string, sector string, content string"
COLUMNS = ["ticker", "company", "sector", "content"]
#: Stands for a null sector, which no folder name can hold.
NO_SECTOR = "\x00"
#: The folder level by which Spark tells sectors apart when it writes several at once.
KEY = "part"


def sector_key(column: str = "sector"):
    return F.coalesce(F.col(column), F.lit(NO_SECTOR))


def parts_of(rows: DataFrame, folder: str, sectors: list[str]) -> dict[str, str]:
    """Write the sectors' rows to a new folder each, in one job; returns where each is. A sector without rows gets none."""
    place = {s: manifest.fresh(folder, f"p{i}") for i, s in enumerate(sectors)}
    stage = manifest.fresh(folder, "write")
    number = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate(sectors)], f"__s string, {KEY} int")
    dealt = rows.join(F.broadcast(number), sector_key() == F.col("__s")).drop("__s")  # one row a sector
    # files of a good size: small sectors share tasks, a large one is split
    dealt.hint("rebalance", KEY).write.partitionBy(KEY).parquet(stage)
    store, root = manifest.opened(folder)
    found, name = {}, lambda uri: f"{root}/data/{uri.rpartition('/')[2]}"
    for i, s in enumerate(sectors):
        if store.get_file_info(f"{name(stage)}/{KEY}={i}").type == manifest.fs.FileType.Directory:
            store.move(f"{name(stage)}/{KEY}={i}", name(place[s]))
            found[s] = place[s]
    store.delete_dir(name(stage))
    return found


def create(reports: DataFrame, folder: str) -> int:
    """Store reports (ticker, company, sector, content; a ticker once) as a new table; returns its version."""
    rows = reports.select(*COLUMNS)
    sectors = [r[0] for r in rows.select(sector_key().alias("s")).distinct().orderBy("s").collect()]  # as many as the manifest has lines
    return manifest.swap(folder, 0, {"parts": parts_of(rows, folder, sectors)})


def load(spark: SparkSession, folder: str, sectors: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The reports of the table, or of some sectors, whose folders alone are read. A version that is kept may be named."""
    _, state = manifest.read(folder, version)
    wanted = [uri for s, uri in state.get("parts", {}).items() if sectors is None or s in sectors]
    return spark.read.schema(REPORT).parquet(*wanted) if wanted else spark.createDataFrame([], REPORT)


def merge(changes: DataFrame, folder: str, keep: int = 2) -> dict[str, str]:
    """Put changed reports (ticker, company, sector, content) into the table; returns what became of each touched sector: new, rewritten or gone.

    A ticker that is there is replaced, wherever its sector was; one that is not is added; one with
    null content is deleted. Of a ticker that changes twice one row must be chosen before. keep: versions that stay readable.
    """
    spark = changes.sparkSession
    version, state = manifest.read(folder)
    parts: dict[str, str] = state.get("parts", {})
    rows = changes.select(*COLUMNS)
    tickers = rows.select("ticker").distinct()
    if rows.groupBy("ticker").count().where("count > 1").limit(1).count():
        raise ValueError("a ticker changes twice")
    # which folders hold a changed ticker: only the ticker column of the table is read
    where = load(spark, folder).select("ticker", "sector").join(tickers, "ticker", "left_semi").select(sector_key().alias("s"))
    into = rows.where("content is not null").select(sector_key().alias("s"))
    touched = [r[0] for r in where.unionByName(into).distinct().orderBy("s").collect()]
    if not touched:
        return {}
    old = load(spark, folder, [s for s in touched if s in parts]).join(tickers, "ticker", "left_anti")
    written = parts_of(old.select(*COLUMNS).unionByName(rows.where("content is not null")), folder, touched)
    now = {s: uri for s, uri in parts.items() if s not in touched} | written
    manifest.swap(folder, version, {"parts": dict(sorted(now.items()))})
    kept = manifest.versions(folder)[-keep:]
    manifest.vacuum(folder, {uri for v in kept for uri in manifest.read(folder, v)[1]["parts"].values()}, keep)
    return {s: "gone" if s not in written else "rewritten" if s in parts else "new" for s in touched}
