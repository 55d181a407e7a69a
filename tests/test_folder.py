"""Folders of files: listed and read by tasks, with the rows of Spark's own sources."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomtext.plans import queries as Q
from fathomtext.sources import fileset, folder
from fathomtext.sources import reports as S

FILES = {
    "1101_甲+公司.md": "a", "notes.md": "b", "x.txt": "c", "empty.md": "", "A/1101_z%41 b.md": "é中\r\nx\n", "A/deep/1102_y.md": "d", "A/deep/er/still/1103_w.md": "e", "B c/1104x.md": "f", "B c/_2201_u.md": "g",
    "B c/.2202_t.md": "h", ".git/2203_s.md": "i", "_old/2204_r.md": "j", "_k=1/2205_q.md": "k", "sector=A/2206_p.md": "l", "C/UP.MD": "m", "C/2207_o.md._COPYING_": "n", "C/bom.md": "﻿o",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("walks")
    for name, text in FILES.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(text.encode())
    (at / "C/raw.md").write_bytes(b"\xff\xfe bad")
    return str(at)


def rows(df):
    return sorted((r["path"], bytes(r["b"])) for r in df.select("path", F.col("content").cast("binary").alias("b")).collect())


def by_spark(spark, path, recursive):
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    return files.select(folder.decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))


@pytest.mark.parametrize("below", ["", "/", "/*", "/?", "/A", "/*/deep", "/notes.md", "/{A,C}"])
def test_every_file_that_spark_finds(spark, root, below):
    want = rows(by_spark(spark, root + below, True))
    assert rows(S.read_all_markdown(spark, root + below)) == want and want
    assert rows(S.read_all_markdown(spark, f"file:{root}{below}")) == want


@pytest.mark.parametrize("below", ["", "/*", "/{A,B c}"])
def test_files_of_the_folders_below(spark, root, below):
    want = rows(by_spark(spark, f"{root}{below}/*/*.md", False))
    assert rows(folder.texts(spark, root + below, recursive=False)) == want and want


def test_the_driver_holds_no_file(spark, root):
    for df in (S.read_all_markdown(spark, root), S.read_reports(spark, root), S.read_reports(spark, root, recursive=False), S.report_paths(spark, root)):
        assert df.count() and df.inputFiles() == []
    with pytest.raises(FileNotFoundError):
        S.read_all_markdown(spark, f"{root}/none")


def test_walks_without_a_file(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT CAST(1 AS BIGINT) AS s_suppkey, 'S' AS s_name, 1 AS s_nationkey, 1.0 AS s_acctbal LIMIT 0) TO '{tmp_path}/supplier.parquet'")
    assert Q.QUERIES["report_walks"](spark, str(tmp_path)).count() == 0


def test_a_commit_holds_a_bounded_part_of_a_list(tmp_path, monkeypatch):
    writer = fileset.FileSetWriter(f"file://{tmp_path}", False, "job1")
    message = writer.write(iter([pa.RecordBatch.from_pydict({"path": [f"s{i % 3}/{i}.md" for i in range(100)], "content": [f"new {i}" for i in range(100)]})]))
    taken, ahead, listed, place = [0], [], fileset.entries, fileset.place

    def counted(store, listing):
        for x in listed(store, listing):
            taken[0] += 1
            yield x

    def moved(store, staged, final):
        ahead.append(taken[0] - len(ahead))
        place(store, staged, final)

    monkeypatch.setattr(fileset, "entries", counted)
    monkeypatch.setattr(fileset, "place", moved)
    monkeypatch.setattr(fileset, "MOVERS", 1)
    monkeypatch.setattr(fileset, "HELD", 7, raising=False)
    writer.commit([message])
    assert max(ahead) <= 7 and len(ahead) == 100
    assert {p.name: p.read_text() for p in tmp_path.glob("s*/*.md")} == {f"{i}.md": f"new {i}" for i in range(100)}
