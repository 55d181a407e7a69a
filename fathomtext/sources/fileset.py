"""A data source that writes whole text files in one transaction.

    rows.write.format("fileset").mode("append").save("file:///data/reports")

rows: path, content. Rows of one path that follow each other are the lines of one file. Each task
attempt writes its files below a staging folder of its own and names them in a list beside them; only
when all tasks are done are the files moved to their places, by one commit. If a task fails for
good nothing has been moved and the staging folder is deleted, so the old files stay; of a task that
Spark started twice only one attempt's list is committed.

The commit first stores what it is about to do. A driver that dies half-way through its moves leaves
that record, and the next commit, or ``recover``, finishes it: afterwards either all files of a job are
there or none. With mode "overwrite" Markdown files that the job did not write are deleted last.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING = ".fileset"
#: Moves at once in a commit, and files of a list that it holds at a time.
MOVERS, HELD = 16, 5000


@dataclass
class Staged(WriterCommitMessage):
    """Where a task's list of files is, and how many it holds."""

    listing: str
    files: int


class FileSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fileset"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> FileSetWriter:
        return FileSetWriter(self.options["path"], overwrite, self.options.get("job", uuid.uuid4().hex))


class FileSetWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, job: str):
        self.folder, self.overwrite, self.job = folder, overwrite, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = fs.FileSystem.from_uri(self.folder)
        stage = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(stage, recursive=True)
        listing, files, at, out = f"{stage}/list", 0, None, None
        with store.open_output_stream(listing) as names:
            for b in iterator:
                for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                    if path is None or content is None:
                        continue
                    if path == at:
                        out.write(f"\n{content}".encode())
                        continue
                    if out:
                        out.close()
                    at = safe(path)
                    names.write((json.dumps([f"{stage}/{files}", at]) + "\n").encode())
                    out = store.open_output_stream(f"{stage}/{files}")
                    out.write(content.encode())
                    files += 1
            if out:
                out.close()
        return Staged(listing, files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        finish(store, root)
        found = [m for m in messages if m is not None]
        record = {"job": self.job, "lists": [m.listing for m in found], "files": sum(m.files for m in found), "overwrite": self.overwrite}
        store.create_dir(f"{root}/{STAGING}", recursive=True)
        held = f"{root}/{STAGING}/{self.job}.begun"
        with store.open_output_stream(held) as out:
            out.write(json.dumps(record).encode())
        store.move(held, f"{root}/{STAGING}/{self.job}.commit")
        finish(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(f"{root}/{STAGING}", recursive=True)
        with store.open_output_stream(f"{root}/{STAGING}/{self.job}.aborted"):
            pass  # tasks that still run may stage more; the next commit clears it away
        clear(store, f"{root}/{STAGING}/{self.job}")


def clear(store: fs.FileSystem, folder: str) -> None:
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


def safe(path: str) -> str:
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"{path} leads out of the folder")
    return path


def entries(store: fs.FileSystem, listing: str) -> Iterator[tuple[str, str]]:
    with store.open_input_stream(listing) as f, io.TextIOWrapper(f, "utf-8") as lines:
        for line in lines:
            staged, path = json.loads(line)
            yield staged, path


def finish(store: fs.FileSystem, root: str) -> None:
    """Carry out the commits on record: move what has not been moved yet, then forget them."""
    if store.get_file_info(f"{root}/{STAGING}").type != fs.FileType.Directory:
        return
    for info in store.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
        if info.path.endswith(".aborted"):
            clear(store, info.path.removesuffix(".aborted"))
            store.delete_file(info.path)
        if not info.path.endswith(".commit"):
            continue
        with store.open_input_stream(info.path) as f:
            record = json.loads(f.read())
        written: set[str] = set()
        with ThreadPoolExecutor(MOVERS) as pool:
            for listing in record["lists"]:
                for parts in batched(entries(store, listing), HELD):
                    for folder in {f"{root}/{path}".rpartition("/")[0] for _, path in parts}:
                        store.create_dir(folder, recursive=True)
                    list(pool.map(lambda x: place(store, x[0], f"{root}/{x[1]}"), parts))
                    if record["overwrite"]:
                        written |= {path for _, path in parts}
        if record["overwrite"]:
            for old in store.get_file_info(fs.FileSelector(root, recursive=True)):
                name = old.path.removeprefix(root).lstrip("/")
                if old.type == fs.FileType.File and name.endswith(".md") and not name.startswith(STAGING) and name not in written:
                    store.delete_file(old.path)
        clear(store, f"{root}/{STAGING}/{record['job']}")
        store.move(info.path, f"{root}/{STAGING}/{record['job']}.done")


def place(store: fs.FileSystem, staged: str, final: str) -> None:
    """Move one file; a file that an earlier, broken-off commit has moved is gone from the staging folder."""
    if store.get_file_info(staged).type == fs.FileType.File:
        store.move(staged, final)


def recover(folder: str) -> None:
    """Finish a commit that broke off, and clear away what aborted jobs have staged."""
    finish(*fs.FileSystem.from_uri(folder))


def write_files(rows: DataFrame, folder: str, overwrite: bool = False) -> int:
    """Write path, content rows below a folder that all executors reach, all or none of them; returns the number of files."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(FileSet)
    job = uuid.uuid4().hex
    rows.select("path", "content").write.format("fileset").option("job", job).mode("overwrite" if overwrite else "append").save(folder)
    store, root = fs.FileSystem.from_uri(folder)
    done = f"{root}/{STAGING}/{job}.done"
    with store.open_input_stream(done) as f:
        n = json.loads(f.read())["files"]
    store.delete_file(done)
    return n
