"""Token counts of documents in flat token files without an index.

A file is a bare sequence of token ids, one end-of-document id after each document. It is cut into
blocks of equal size that any task can read on its own. In each block one vectorised comparison
finds the separators. A prefix scan over the blocks' summaries then stitches them: a running maximum
of the last separator gives where the document that a block begins in has its start, a running sum
of separators gives each document's number in the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import public_table
from .shared import materialize, prepare, remove, scratch, table, texts

#: The id that ends a document (free in the public rank files), the type of ids, bytes of a block, blocks of a task.
EOD, KIND, BLOCK_BYTES, BLOCKS_A_TASK = 50256, "<u2", 4 << 20, 4


def opened(uri: str):
    """The file system and path of a URI as Hadoop writes it; its names for S3 are s3 elsewhere."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def take_name(store, held: str, name: str) -> None:
    """Give a complete file its name; where another attempt of the task was first, its equal file stays."""
    from pyarrow import fs

    try:
        store.move(held, name)
    except OSError:
        if store.get_file_info(name).type != fs.FileType.File:
            raise
        store.delete_file(held)


def write_token_files(docs: DataFrame, folder: str, eod: int = EOD, kind: str = KIND, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode documents into one flat file for each partition; a row doc_id, file, ordinal for each document.

    A file takes its name only when it is complete, and a task that runs again writes the same one.
    The rows come with the files: write them once, do not evaluate them again.
    """
    prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        path, pat = (rank_file, pattern) if rank_file else public_table()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        use = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.tokens"
        to, root = opened(folder)
        to.create_dir(root, recursive=True)
        held, n = f"{root}/.{name}.{task.taskAttemptId()}", 0
        with to.open_output_stream(held) as out:
            for b in batches:
                for t in b.column(1).to_pylist():
                    out.write(np.array([*use.encode_ordinary(t), eod], dtype=kind).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * b.num_rows, pa.string()), pa.array(np.arange(n, n + b.num_rows))], ["doc_id", "file", "ordinal"])
                n += b.num_rows
        take_name(to, held, f"{root}/{name}")

    return texts(docs).mapInArrow(each, "doc_id long, file string, ordinal long")


def blocks_of(spark: SparkSession, folder: str, kind: str, block_bytes: int) -> DataFrame:
    """file, block, first (token), tokens of each block: one row per file is listed, Spark makes the blocks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    width, step = np.dtype(kind).itemsize, block_bytes // np.dtype(kind).itemsize
    found = [(x.getPath().getName(), x.getLen() // width) for x in store.listStatus(path) if x.getPath().getName()[0] not in "._"] if store.exists(path) else []
    files = spark.createDataFrame(found, "file string, size long")
    cut = files.select("file", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(step).cast("long"))).alias("block", "first"))
    parts = max(1, (len(found) + sum(n for _, n in found) // step) // BLOCKS_A_TASK)
    return cut.select("file", "block", "first", F.least(F.lit(step), F.col("size") - F.col("first")).alias("tokens"), "size").repartition(parts, "file", "block")


def scan(spark: SparkSession, folder: str, eod: int = EOD, kind: str = KIND, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of a folder's token files: file, ordinal, start, n_tokens, terminated.

    start and n_tokens count ids, the separator not included; two separators on end are an empty
    document. Ids after the last separator of a file are a last document that is not terminated.
    A file without ids has no documents; bytes that do not fill an id are ignored.
    """
    width = np.dtype(kind).itemsize

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = opened(folder)
        for b in batches:
            ends = []
            for name, first, n in zip(*(b.column(k).to_pylist() for k in ("file", "first", "tokens")), strict=True):
                with at.open_input_file(f"{root}/{name}") as f:
                    f.seek(first * width)
                    ids = np.frombuffer(f.read(n * width), dtype=kind)
                ends.append(first + np.flatnonzero(ids == eod))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("file", "block", "first", "tokens", "size")), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "first", "tokens", "size", "ends"])

    seen = materialize(blocks_of(spark, folder, kind, block_bytes).mapInArrow(find, "file string, block int, first long, tokens long, size long, ends array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = seen.select("file", "block", F.size("ends").cast("long").alias("n"), F.array_max("ends").alias("last"))
    sums = sums.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"))
    met = seen.join(sums, ["file", "block"])
    final = (F.col("first") + F.col("tokens") == F.col("size")) & (F.col("size") > F.coalesce(F.array_max("ends") + 1, F.col("open")))
    stops = F.when(final, F.concat("ends", F.array("size"))).otherwise(F.col("ends"))
    starts = F.slice(F.concat(F.array("open"), F.transform("ends", lambda x: x + 1)), F.lit(1), F.size(stops))
    docs = F.zip_with(starts, stops, lambda s, e: F.struct(s.alias("start"), (e - s).alias("n_tokens")))
    rows = met.select("file", "base", F.size("ends").alias("n"), F.posexplode(docs).alias("i", "d"))
    return rows.select("file", (F.col("base") + F.col("i")).alias("ordinal"), "d.start", "d.n_tokens", (F.col("i") < F.col("n")).alias("terminated"))


def count_tokens(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, counted in token files that are written for the purpose.

    Null texts count as empty and have no tokens. Rows stay as they are, repeated ones and ones
    without an id too; other columns are ignored. Empty in, empty out.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    owners = materialize(write_token_files(docs, folder), "owners")
    counts = materialize(scan(spark, folder), "counts")
    remove(spark, folder)
    return owners.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
