"""Files written in one transaction: a failed task or a broken-off commit leaves no half."""

import json
import time

import pytest
from pyspark.sql import functions as F

from fathomtext.sources import fileset
from fathomtext.sources.fileset import STAGING, FileSetWriter, Staged, write_files


def files_of(folder):
    return {str(p.relative_to(folder)): p.read_text("utf-8") for p in folder.rglob("*") if p.is_file() and STAGING not in p.parts}


def test_files_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a/1.md", "one"), ("a/1.md", "two\nthree"), ("b/c/2.md", "é中"), (None, "x"), ("3.md", None), ("4.md", "")], "path string, content string").coalesce(1)
    assert write_files(rows, f"file://{tmp_path}") == 3
    assert files_of(tmp_path) == {"a/1.md": "one\ntwo\nthree", "b/c/2.md": "é中", "4.md": ""}
    assert write_files(rows.limit(0), f"file://{tmp_path}") == 0
    assert write_files(spark.createDataFrame([("4.md", "new")], "path string, content string"), f"file://{tmp_path}") == 1
    assert files_of(tmp_path)["4.md"] == "new" and len(files_of(tmp_path)) == 3
    assert not [p for p in (tmp_path / STAGING).rglob("*") if p.is_file()]


def test_many_files_over_many_tasks(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 7, F.lit("/"), "id", F.lit(".md")).alias("path"), F.concat(F.lit("text "), "id").alias("content")).repartition(9)
    assert write_files(rows, f"file://{tmp_path}") == 500
    assert files_of(tmp_path) == {f"s{i % 7}/{i}.md": f"text {i}" for i in range(500)}


def test_a_failing_task_leaves_the_old_files(spark, tmp_path):
    old = spark.range(40).select(F.concat("id", F.lit(".md")).alias("path"), F.lit("old").alias("content"))
    write_files(old, f"file://{tmp_path}")
    broken = spark.range(40).repartition(8).select(F.concat("id", F.lit(".md")).alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("new")).alias("content"))
    for overwrite in (False, True):
        with pytest.raises(Exception, match="broken"):
            write_files(broken, f"file://{tmp_path}", overwrite)
        assert files_of(tmp_path) == {f"{i}.md": "old" for i in range(40)}
        time.sleep(1)  # tasks that were still running
        fileset.recover(f"file://{tmp_path}")
        assert not [p for p in (tmp_path / STAGING).rglob("*") if p.is_file()]


def test_overwrite_takes_the_rest_away(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("1.md", "sub/2.md", "notes.txt"):
        (tmp_path / name).write_text("old")
    assert write_files(spark.createDataFrame([("1.md", "new")], "path string, content string"), f"file://{tmp_path}", overwrite=True) == 1
    assert files_of(tmp_path) == {"1.md": "new", "notes.txt": "old"}


def test_a_commit_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    (tmp_path / "2.md").write_text("old")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"path": [f"{i}.md" for i in range(6)], "content": [f"new {i}" for i in range(6)]})
    writer = FileSetWriter(folder, False, "job1")
    lost = writer.write(iter([batch]))  # an attempt that is not committed
    message = writer.write(iter([batch]))
    moved, plain = [], fileset.place

    def dies(store, staged, final):
        if len(moved) == 3:
            raise OSError("the driver died")
        moved.append(final)
        plain(store, staged, final)

    monkeypatch.setattr(fileset, "MOVERS", 1)
    monkeypatch.setattr(fileset, "place", dies)
    with pytest.raises(OSError):
        writer.commit([message, None])
    monkeypatch.setattr(fileset, "place", plain)
    assert len(files_of(tmp_path)) < 6
    fileset.recover(folder)
    assert files_of(tmp_path) == {f"{i}.md": f"new {i}" for i in range(6)}
    assert json.loads((tmp_path / STAGING / "job1.done").read_text())["files"] == 6
    assert isinstance(lost, Staged) and not (tmp_path / STAGING / "job1").exists()
    fileset.recover(folder)
    assert len(files_of(tmp_path)) == 6


def test_paths_stay_in_the_folder(spark, tmp_path):
    for path in ("../x.md", "/x.md", "a/../../x.md"):
        with pytest.raises(Exception, match="leads out"):
            write_files(spark.createDataFrame([(path, "x")], "path string, content string"), f"file://{tmp_path}/in")
