"""Session helpers that the operators of this subpackage share.

Intermediate results go to Parquet below the folder that ``spark.checkpoint.dir`` names, so that
every executor can read them again after another one is lost. Only where that setting is unset
(tests on one machine) is a temporary folder made and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; with the byte bound below it keeps a Python worker's memory small.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fathomtext-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark).rstrip('/')}/fathomtext/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; a session that has ended is left alone."""
    if spark.sparkContext._jsc is None:
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and no executor's loss matters."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._fathom_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._fathom_path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files and broadcasts of finished jobs, which else stay until the driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark has to understand."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns: the key as it is and the text with null as empty; all else is left behind."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def stored(docs: DataFrame, name: str) -> DataFrame:
    """docs as a plain scan of files: itself if it is one, else written to the shared folder and read back."""
    scan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return docs if scan and docs.columns else materialize(docs, name)


def row_key(docs: DataFrame) -> list[Column]:
    """file, pos: which row of which file a row of a stored() table is.

    Unlike a number dealt out while reading, it is the same in every reading, whatever the number of
    tasks, executors lost or won on the way, and the size of splits.
    """
    where = docs.metadataColumn("_metadata")
    return [F.xxhash64(where["file_path"]).alias("file"), where["row_index"].alias("pos")]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(docs: DataFrame, n: int) -> list[str]:
    """So many names that no column of docs has, in whatever case."""
    longest = max(docs.columns, key=len)
    return [f"{longest}_{i}" for i in range(n)]


def byte_views(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of a string column's values without copies; null as empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = memoryview(offsets).cast("q")[column.offset : column.offset + len(column) + 1] if len(column) else []
    view = memoryview(data) if data is not None else memoryview(b"")
    for i in range(len(column)):
        yield view[ends[i] : ends[i + 1]]
