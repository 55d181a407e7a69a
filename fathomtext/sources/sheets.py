"""A data source for spreadsheets (.xlsx), read as a stream from their zip container.

    spark.read.format("sheet").schema("ticker string, name string").option("sheet", "1").load("file:///data/roster.xlsx")

Columns are taken by position: the n-th field of the schema is the n-th column of the sheet. There is no
header row, unless the option skip says how many rows to leave out. Every file is a task; of a folder
all .xlsx files are read. A cell that is missing or empty is null, whole numbers have no decimal
point, and rows without any value in the columns read are left out. The sheet's rows are never held together; the shared strings of a
workbook are.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return "ticker string, name string"

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options["path"], int(self.options.get("sheet", "1")), int(self.options.get("skip", "0")), [f.dataType.simpleString() for f in schema])


class SheetReader(DataSourceReader):
    def __init__(self, path: str, sheet: int, skip: int, kinds: list[str]):
        self.path, self.sheet, self.skip, self.kinds = path, sheet, skip, kinds

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [InputPartition(root)]
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".xlsx"))
        return [InputPartition(f) for f in found] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.value:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.value) as f, zipfile.ZipFile(Seekable(f)) as book:
            strings = list(shared_strings(book))
            with book.open(f"xl/worksheets/sheet{self.sheet}.xml") as sheet:
                for k, cells in enumerate(rows_of(sheet, strings, len(self.kinds))):
                    if k >= self.skip and any(c is not None for c in cells):
                        yield tuple(cast(c, kind) for c, kind in zip(cells, self.kinds, strict=True))


class Seekable(io.RawIOBase):
    """A store's file as zipfile wants it."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        return self.file.seek(at, whence)

    def read(self, n: int = -1) -> bytes:
        return self.file.read(None if n is None or n < 0 else n)


def shared_strings(book: zipfile.ZipFile) -> Iterator[str]:
    """The workbook's strings by number; of a string in several styles the parts together, without reading aids."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{NS}si":
                yield text_of(e)
                e.clear()


def text_of(item: ElementTree.Element) -> str:
    return "".join(t.text or "" for part in item if part.tag != f"{NS}rPh" for t in ([part] if part.tag == f"{NS}t" else part.iter(f"{NS}t")))


def column_of(reference: str | None, after: int) -> int:
    """The column of a cell like BC12, counted from 0; without a reference the next one."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return after
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def rows_of(sheet: io.IOBase, strings: list[str], width: int) -> Iterator[list[str | None]]:
    """The first columns of each row that the sheet has, as text."""
    for _, e in ElementTree.iterparse(sheet):
        if e.tag == f"{NS}row":
            cells, at = [None] * width, 0
            for c in e.iterfind(f"{NS}c"):
                column = column_of(c.get("r"), at)
                at = column + 1
                if column < width:
                    cells[column] = value_of(c, strings)
            yield cells
            e.clear()


def value_of(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inner = cell.find(f"{NS}is")
        text = None if inner is None else text_of(inner)
    else:
        text = cell.findtext(f"{NS}v")
        if text is not None and kind == "s":
            text = strings[int(text)]
        elif text and kind == "n":
            number = float(text)
            text = str(int(number)) if number.is_integer() and abs(number) < 1e15 else text
        elif text and kind == "b":
            text = "true" if text == "1" else "false"
        elif kind == "e":
            text = None
    return text or None


def cast(text: str | None, kind: str):
    """A cell as the schema's type; null where it is no such value."""
    if text is None or kind == "string":
        return text
    try:
        return float(text) if kind in ("double", "float") else int(float(text)) if kind in ("int", "bigint", "smallint") else None
    except ValueError:
        return None
