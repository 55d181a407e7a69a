"""Markdown folders, listed and read by tasks: the driver holds neither names nor states of files.

Spark's own file sources list a folder on the driver and keep a status of every file for each reading.
Here one task lists the folder itself, what lies in it is dealt to tasks level by level and walked to
the end by them, and the paths are dealt again to be read. A task holds the lists of
one folder and those above it, and texts up to a bound.

What counts as a file is as in Spark's sources: names that begin with a dot or underscore are hidden, and
empty files are left out. A root that only Spark can open or whose pattern has more than * and ? is left to them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fnmatch import fnmatchcase
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GLOB = "*.md"
#: Levels below the root whose folders are dealt to tasks anew; what lies deeper stays with one task.
DEALT = 2
#: Tasks of a core.
TASKS = 4
#: Rows and bytes of text of one Arrow batch.
ROWS, BYTES = 2000, 8 << 20
LISTED = pa.schema([("path", pa.string()), ("depth", pa.int32()), ("found", pa.bool_())])
READ = pa.schema([("path", pa.string()), ("content", pa.binary())])


def decoded(path):
    """A path without percent codes; a plus sign stays."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def opened(base: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and what stands before the store's own paths."""
    if base.startswith("file:"):
        return fs.LocalFileSystem(), "file:"
    store, at = fs.FileSystem.from_uri(base)
    if not base.endswith(at):
        raise ValueError(f"{base} is not a plain path")
    return store, base.removesuffix(at)


def located(spark: SparkSession, root: str, recursive: bool) -> tuple[str, list[str]] | None:
    """The deepest folder of a root without wildcards and the patterns of the levels below it; None if the root is left to Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    parts = whole.split("/")
    first = next((i for i, x in enumerate(parts) if "*" in x or "?" in x), len(parts))
    base, levels = "/".join(parts[:first]), parts[first:]
    try:
        if set("{}[]\\") & set(whole) or base == opened(base)[1]:
            return None
    except (OSError, ValueError, ImportError):  # among them a scheme that pyarrow does not know
        return None
    return base, levels if recursive else [*levels, "*", GLOB]


def hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def within(store: fs.FileSystem, folder: str, depth: int, levels: list[str], recursive: bool) -> Iterator[tuple[str, int, bool]]:
    """path, depth, found of the files that count and the folders to enter in a folder."""
    depth += 1
    for info in store.get_file_info(fs.FileSelector(folder)):
        name = info.base_name
        if not fnmatchcase(name, levels[depth - 1]) if depth <= len(levels) else hidden(name):
            continue
        if info.type == fs.FileType.Directory:
            if recursive or depth < len(levels):
                yield info.path, depth, False
        elif info.type == fs.FileType.File and info.size and (depth >= len(levels) if recursive else depth == len(levels)) and fnmatchcase(name, GLOB) and not hidden(name):
            yield info.path, depth, True


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches bounded by rows and by bytes of text."""
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) == ROWS or size >= BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def listed(batches: Iterator[pa.RecordBatch], base: str, levels: list[str], recursive: bool, whole: bool) -> Iterator[pa.RecordBatch]:
    """Files pass, folders give what is in them, with whole all that lies below them."""
    store, before = opened(base)

    def rows() -> Iterator[tuple]:
        for b in batches:
            for path, depth, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if found:
                    yield path, depth, found
                    continue
                stack = [within(store, path.removeprefix(before), depth, levels, recursive)]
                while stack:
                    inner, deeper, is_file = next(stack[-1], (None, 0, False))
                    if inner is None:
                        stack.pop()
                    elif is_file or not whole:
                        yield before + inner, deeper, is_file
                    else:
                        stack.append(within(store, inner, deeper, levels, recursive))

    yield from batched(rows(), LISTED)


def read(batches: Iterator[pa.RecordBatch], base: str) -> Iterator[pa.RecordBatch]:
    store, before = opened(base)

    def rows() -> Iterator[tuple]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_stream(path.removeprefix(before)) as f:
                    yield path, f.read()

    yield from batched(rows(), READ)


def tasks(spark: SparkSession) -> int:
    return TASKS * spark.sparkContext.defaultParallelism


def paths(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path of the Markdown files below a root, or, if not recursive, of those in the root's own folders."""
    place = located(spark, root, recursive)
    if place is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", str(recursive).lower()).load(root if recursive else f"{root}/*/{GLOB}")
        return files.select(decoded(F.col("_metadata.file_path")).alias("path"))
    base, levels = place
    store, before = opened(base)
    info = store.get_file_info(base.removeprefix(before))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(base)
    is_file = info.type == fs.FileType.File
    rows = spark.range(0, 1, 1, 1).select(F.lit(base).alias("path"), F.lit(0).alias("depth"), F.lit(is_file).alias("found"))
    if is_file and not (info.size and recursive and fnmatchcase(info.base_name, GLOB) and not hidden(info.base_name)):
        rows = rows.limit(0)
    kinds = "path string, depth int, found boolean"
    for _ in range(DEALT):
        rows = rows.mapInArrow(partial(listed, base=base, levels=levels, recursive=recursive, whole=False), kinds).repartition(tasks(spark), "path")
    return rows.mapInArrow(partial(listed, base=base, levels=levels, recursive=recursive, whole=True), kinds).where("found").select("path")


def texts(spark: SparkSession, root: str, recursive: bool = True, chosen: DataFrame | None = None) -> DataFrame:
    """path, content of the Markdown files that paths() gives, or of those of them that are chosen (path)."""
    place = located(spark, root, recursive)
    if place is None:
        files = spark.read.option("pathGlobFilter", GLOB).option("recursiveFileLookup", str(recursive).lower()).text(root if recursive else f"{root}/*/{GLOB}", wholetext=True)
        files = files.select(decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))
        return files if chosen is None else files.join(chosen.select("path"), "path")
    rows = paths(spark, root, recursive) if chosen is None else chosen.select("path")
    return rows.repartition(tasks(spark), "path").mapInArrow(partial(read, base=place[0]), "path string, content binary").select("path", F.col("content").cast("string").alias("content"))
