"""Which reports a command works on."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import vocabulary as V


@dataclass(frozen=True)
class Scope:
    """All reports (both None), those of a sector, or those of a list, which may be empty and then matches none."""

    tickers: tuple[str, ...] | None = None
    sector: str | None = None
    description: str = "ALL tickers"

    @classmethod
    def parse(cls, args: list[str], batches: DataFrame | None = None) -> Scope:
        """No arguments: all. --batch N: that batch's tickers. --sector words: the sector. Else every four-digit argument."""
        if not args:
            return cls()
        if args[0] == "--batch" and len(args) > 1:
            number = int(args[1])
            rows = batches.where(F.col("batch") == number).select(F.explode("tickers").alias("t")).collect() if batches is not None else []
            return cls(tuple(r["t"] for r in rows), None, f"Batch {number}")
        if args[0] == "--sector" and len(args) > 1:
            return cls(None, " ".join(args[1:]), f"sector: {' '.join(args[1:])}")
        found = tuple(a for a in args if re.fullmatch(r"\d{4}", a, re.A))
        return cls(found, None, f"tickers: {', '.join(found)}")

    def predicate(self, ticker: str = "ticker", sector: str = "sector") -> Column:
        """Sectors compare without regard to case."""
        if self.tickers is not None:
            return F.col(ticker).isin(*self.tickers) if self.tickers else F.lit(False)
        if self.sector is not None:
            return F.lower(F.col(sector)) == F.lower(F.lit(self.sector))
        return F.lit(True)

    def of(self, reports: DataFrame) -> DataFrame:
        return reports.where(self.predicate())


def profile_of(keyword: str) -> str:
    """The profile whose first keyword the search word contains; case matters."""
    if any(k in keyword for k in V.TECH_KEYWORDS):
        return "tech"
    if any(k in keyword for k in V.ENERGY_KEYWORDS):
        return "energy"
    return "all"


def profile_sectors(profile: str) -> list[str] | None:
    """The sectors of a profile in order of their groups, or None for all."""
    groups = V.PROFILES[profile]
    return None if groups is None else list(dict.fromkeys(s for g in groups for s in V.SECTOR_GROUPS[g]))


def in_sectors(df: DataFrame, sectors: list[str] | None, column: str = "sector") -> DataFrame:
    """Rows of these sectors, case mattering; a partition filter on tables laid out by sector."""
    return df if sectors is None else df.where(F.col(column).isin(*sectors))


def parse_batches(lines: DataFrame) -> DataFrame:
    """batch, done, sector, tickers of checklist lines (value); other lines are left out, of a repeated number the first counts."""
    v = F.col("value")
    body = F.regexp_replace(F.regexp_extract(v, r"(?i)Batch\s+\d+\*\*.*?:[:\s]*(.*)$", 1), r"\.+\s*$", "")
    tickers = F.filter(F.transform(F.split(body, ","), lambda x: F.regexp_extract(x, r"(\d{4})", 1)), lambda x: x != "")
    rows = lines.where(v.rlike(r"(?i)Batch\s+\d+\*\*")).select(
        F.monotonically_increasing_id().alias("line"),
        F.regexp_extract(v, r"(?i)Batch\s+(\d+)\*\*", 1).cast("int").alias("batch"), v.rlike(r"\[x\]\s*\*\*Batch\s+\d+\*\*").alias("done"),
        F.nullif(F.regexp_extract(v, r"\*\*\s*\(([^)]*)\)", 1), F.lit("")).alias("sector"), tickers.alias("tickers"))
    first = rows.groupBy("batch").agg(F.min_by(F.struct("done", "sector", "tickers"), "line").alias("r"))
    return first.select("batch", "r.*")


def without(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not excluded (exclusion list, existing output)."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def empty_batches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "batch int, done boolean, sector string, tickers array<string>")
