"""Landing tables of market data: what a fetcher has stored, read as Parquet or JSON."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STATEMENTS = "ticker string, source string, period_kind string, period_end date, statement string, item string, value double"
QUOTES = (
    "ticker string, source string, trailingPE double, forwardPE double, priceToSalesTrailing12Months double, priceToBook double, enterpriseToEbitda double, "
    "currentPrice double, mostRecentQuarter bigint, nextFiscalYearEnd bigint, marketCap double, enterpriseValue double, sector string, industry string"
)
#: Suffixes of the exchanges, in order of preference.
SOURCES = ["TW", "TWO"]


def read_landing(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A landing table in its fixed schema; NaN is null."""
    rows = spark.read.format(kind).schema(schema).load(path)
    return rows.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in rows.schema if f.dataType.simpleString() == "double"})


def read_statements(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return read_landing(spark, path, STATEMENTS, kind)


def read_quotes(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return read_landing(spark, path, QUOTES, kind)


class LandingSource(DataSource):
    """spark.read.format("landing").option("kind", "quotes" or "statements").load(folder): JSON lines that a fetcher left, one task a file."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return QUOTES if self.options.get("kind", "statements") == "quotes" else STATEMENTS

    def reader(self, schema) -> LandingReader:
        return LandingReader(self.options["path"], schema)


class LandingReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [InputPartition(f.path) for f in found if f.type == fs.FileType.File and f.path.endswith((".json", ".jsonl"))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """A row for each line; a field that is missing, NaN or of another type is null."""
        from pyarrow import fs

        if not partition.value:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.value) as f:
            for line in io.TextIOWrapper(f, "utf-8"):
                if line.strip():
                    row = json.loads(line)
                    yield tuple(cast(row.get(c.name), c.dataType.simpleString()) for c in self.schema)


def cast(value, kind: str):
    if isinstance(value, bool) or value is None or value != value:
        return None
    if kind == "double":
        return float(value) if isinstance(value, int | float) else None
    if kind == "bigint":
        return int(value) if isinstance(value, int | float) else None
    if kind == "date":
        return date.fromisoformat(value[:10]) if isinstance(value, str) else None
    return str(value)
