"""A data source that fetches statements or quotes from an HTTP service that answers by ticker.

    spark.read.format("market").option("kind", "statements").load("http://host/api").where("ticker = '1101' and period_end >= '2023-01-01'")

The service lists its tickers at URL/kind as JSON lines {"ticker", "bytes"} and gives one ticker's rows at
URL/kind/TICKER as JSON lines, for statements between from and to if asked. Filters on ticker and
period_end are pushed down: only those tickers are asked for, in those periods. Tickers are dealt to
tasks by size. All tasks together keep to ``rate`` requests a second; a request that
fails for a while (429, 5xx, no connection) is tried again after growing pauses.

Options: kind (statements or quotes), rate (0: as fast as it goes), retries, pause (seconds before the
second try), timeout, task_bytes (what one task fetches at most, a larger ticker alone).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .market import QUOTES, STATEMENTS, cast


@dataclass
class Tickers(InputPartition):
    """What one task asks for, and how many tasks share the rate."""

    names: list[str]
    tasks: int


class MarketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "market"

    def schema(self) -> str:
        return QUOTES if self.options.get("kind", "statements") == "quotes" else STATEMENTS

    def reader(self, schema) -> MarketReader:
        return MarketReader(self.options["path"].rstrip("/"), dict(self.options), schema)


class MarketReader(DataSourceReader):
    def __init__(self, url: str, options: dict[str, str], schema):
        self.kind, self.schema = options.get("kind", "statements"), schema
        self.url = f"{url}/{self.kind}"
        number = lambda k, default: float(options.get(k, default))
        self.rate, self.retries, self.pause, self.timeout, self.task_bytes = number("rate", 0), int(number("retries", 4)), number("pause", 0.5), number("timeout", 30), number("task_bytes", 1 << 20)
        self.only: set[str] | None = None
        self.since: date | None = None
        self.until: date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what names tickers or bounds the period; all else is left to Spark."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("ticker",) and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            elif column == ("period_end",) and self.kind == "statements" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                day = timedelta(days=1)
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    low = f.value + day * isinstance(f, GreaterThan)
                    self.since = low if self.since is None else max(self.since, low)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    high = f.value - day * isinstance(f, LessThan)
                    self.until = high if self.until is None else min(self.until, high)
            else:
                yield f

    def partitions(self) -> list[Tickers]:
        if self.only is not None:
            sizes = [(t, 0) for t in sorted(t for t in self.only if t)]  # a service need not list them all for that
        else:
            sizes = [(r["ticker"], r.get("bytes") or 0) for r in map(json.loads, self.lines(self.url))]
        groups: list[list[str]] = []
        held = self.task_bytes + 1
        for ticker, size in sizes:
            if held + size > self.task_bytes:
                groups.append([])
                held = 0
            groups[-1].append(ticker)
            held += size
        return [Tickers(g, len(groups)) for g in groups] or [Tickers([], 1)]

    def read(self, partition: Tickers) -> Iterator[tuple]:
        """The rows of a task's tickers; a ticker that the service does not know has none."""
        period = {k: v.isoformat() for k, v in (("from", self.since), ("to", self.until)) if v is not None}
        if self.since and self.until and self.since > self.until:
            return
        apart, last = partition.tasks / self.rate if self.rate else 0, 0.0
        for ticker in partition.names:
            if (wait := last + apart - time.monotonic()) > 0:
                time.sleep(wait)
            last = time.monotonic()
            query = f"?{urllib.parse.urlencode(period)}" if period else ""
            for line in self.lines(f"{self.url}/{urllib.parse.quote(ticker, safe='')}{query}"):
                row = json.loads(line)
                yield tuple(cast(row.get(c.name), c.dataType.simpleString()) for c in self.schema)

    def lines(self, url: str) -> list[bytes]:
        """An answer's lines; 404 has none, and what may pass is tried again."""
        for k in range(self.retries + 1):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:  # noqa: S310
                    return [x for x in answer.read().splitlines() if x.strip()]
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return []
                if e.code != 429 and e.code < 500 or k == self.retries:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if k == self.retries:
                    raise
            time.sleep(self.pause * 2**k)
        return []


def register(spark: SparkSession) -> None:
    """Make the source known to a session and let it take filters."""
    spark.dataSource.register(MarketSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
