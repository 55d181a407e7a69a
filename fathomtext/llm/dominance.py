"""How many points of a plane lie above each point: blocked two-dimensional cumulative sums.

A point is above another if its slot is smaller and its level is strictly larger. Points of the same
slot and level are one cell with summed weights. Cells have two strict orders: x by slot, then level,
and y by falling level, then falling slot. A cell is above another exactly if it comes before it in
both, so ties need no care, and a slot or level that a third of all rows share is cut like any other.

Each order is range-partitioned, sorted and cut into strips of at most so many cells; a strip of x and
one of y cross in a tile. What is above a cell lies in its own strip of x (the row that is carried
along), in its own strip of y but in an earlier one of x (the carried column), or in a tile before its
own in both orders. The first two are counted within one strip each, in numpy; the tiles are cells
again, by far fewer, and are counted by the same steps. The sums go back by merge joins, never by a broadcast. Strips grow with the square root of the
cells, so the tiles are at most about a sixteenth as many as the cells. No step gives a task, the driver or a broadcast
more than one strip.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, fresh, materialize, table

#: Cells of a strip while there are few, and how a strip grows: so many times the square root of the cells.
STRIP, ROOTS = 1 << 16, 4
SECONDS, CENTS, COPIES = 60, 1, 5
CELL = "slot long, level long, sales long, rows long"


def corner_sums(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each point, in order of x, the summed weights w (points, kinds) of those before it that have a smaller y.

    y: a permutation of 0, 1, .... Blocks of about a root of the points cut both orders: whole tiles come from
    cumulative sums over both axes, the rest from comparing the points of one block with each other.
    """
    n = len(y)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    x = np.arange(n)
    tiles = np.zeros((blocks + 1, blocks + 1, w.shape[1]), dtype=np.int64)
    np.add.at(tiles, (x // size + 1, y // size + 1), w)
    out = tiles.cumsum(axis=0).cumsum(axis=1)[x // size, y // size]
    earlier = np.tri(size, k=-1, dtype=bool)
    order = np.argsort(y)
    for k in range(0, n, size):
        own = slice(k, k + size)
        m = len(y[own])
        out[own] += ((y[own] < y[own, None]) & earlier[:m, :m]).astype(np.int64) @ w[own]  # the same block of x
        at = order[own]
        out[at] += (((at // size) < (at // size)[:, None]) & earlier[:m, :m]).astype(np.int64) @ w[at]  # the same block of y, earlier ones of x
    return out


def strips(size: int, count: Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]]) -> Callable:
    """For mapInArrow over sorted partitions: what count makes of the columns of each run of so many rows and of its number in the partition."""

    def done(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in count({c: t[c].to_numpy() for c in t.column_names}, number).items()})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - rows)
                held.append(part)
                rows, b = rows + part.num_rows, b.slice(part.num_rows)
                if rows == size:
                    yield done(held, number)
                    held, rows, number = [], 0, number + 1
        if rows:
            yield done(held, number)

    return each


def ranks(*keys: np.ndarray) -> np.ndarray:
    """The place of each point in the order by the last key, ties by the one before, and so on."""
    out = np.empty(len(keys[0]), dtype=np.int64)
    out[np.lexsort(keys)] = np.arange(len(out))
    return out


def strip_of(part: np.ndarray, number: int) -> np.ndarray:
    """A strip's number among all, rising with the order that the partitions follow."""
    return (part << 31) + number


def in_row(c: dict[str, np.ndarray], number: int) -> dict[str, np.ndarray]:
    """A strip of x, sorted by x: s, r, what is above each cell within the strip, and i, the strip."""
    sums = corner_sums(ranks(-c["slot"], -c["level"]), np.stack([c["sales"], c["rows"]], axis=1))
    return {k: c[k] for k in ("slot", "level", "sales", "rows")} | {"i": strip_of(c["part"], number), "s": sums[:, 0], "r": sums[:, 1]}


def in_column(c: dict[str, np.ndarray], number: int) -> dict[str, np.ndarray]:
    """A strip of y, sorted by y: s, r with what is above each cell within the strip, in an earlier strip of x, and j, the strip."""
    # with the places as x, the strips of x as y: of one strip of x the later place goes first, so that none counts for another
    sums = corner_sums(ranks(-np.arange(len(c["i"])), c["i"]), np.stack([c["sales"], c["rows"]], axis=1))
    return {k: c[k] for k in ("slot", "level", "sales", "rows", "i")} | {"j": strip_of(c["part"], number), "s": c["s"] + sums[:, 0], "r": c["r"] + sums[:, 1]}


def above(cells: DataFrame, least: int = STRIP, roots: int = ROOTS) -> DataFrame:
    """slot, level, s, r: for each cell (slot, level, sales, rows; no cell twice) the sales and rows of the cells above it.

    cells is read more than once and so has to be a stored table.
    """
    spark, n = cells.sparkSession, cells.count()
    size = max(least, 1 << math.ceil(math.log2(roots * math.sqrt(n) + 1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x, y, part = ("slot", "level"), (F.desc("level"), F.desc("slot")), F.spark_partition_id().cast("long").alias("part")
    cells = cells.select("slot", "level", "sales", "rows")
    dealt = cells.repartitionByRange(parts, *x) if n > size else cells.repartition(1)  # of one strip at most
    by_x = dealt.sortWithinPartitions(*x).select("*", part)
    rows = by_x.mapInArrow(strips(size, in_row), f"{CELL}, i long, s long, r long")
    if n <= size:
        return rows.select("slot", "level", "s", "r")
    rows = materialize(rows, "rows")
    by_y = rows.repartitionByRange(parts, *y).sortWithinPartitions(*y).select("*", part)
    both = materialize(by_y.mapInArrow(strips(size, in_column), f"{CELL}, i long, j long, s long, r long"), "columns")
    forget(rows)
    # a tile is a cell again: its slot is the strip of x, its level falls as the strip of y grows
    tiles = materialize(both.groupBy(F.col("i").alias("slot"), (-F.col("j")).alias("level")).agg(F.sum("sales").alias("sales"), F.sum("rows").alias("rows")), "tiles")
    corner = above(tiles, least, roots).select(F.col("slot").alias("i"), (-F.col("level")).alias("j"), F.col("s").alias("cs"), F.col("r").alias("cr"))
    return both.join(corner.hint("merge"), ["i", "j"]).select("slot", "level", (F.col("s") + F.col("cs")).alias("s"), (F.col("r") + F.col("cr")).alias("r"))


def dominance_counts(points: DataFrame, slot: str = "slot", level: str = "level", weight: str | None = None) -> DataFrame:
    """points with n_sales, the points above each, and n_rows, their summed weights (1 where weight is None or null).

    A point is above another if its slot is smaller and its level strictly larger; repeated rows are
    points of their own, and those of one cell are not above each other. Points with a null slot or
    level are above none and get null counts; points that none is above get 0. Other columns of any
    name pass through, but columns named n_sales and n_rows are replaced. An empty table gives an empty result.
    """
    a, b, w = fresh(points, 3)
    keep = points.drop("n_sales", "n_rows")
    named = keep.withColumns({a: F.col(slot).cast("long"), b: F.col(level).cast("long"), w: F.coalesce(F.col(weight).cast("long"), F.lit(1)) if weight else F.lit(1).cast("long")})
    whole = named.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = materialize(whole.groupBy(F.col(a).alias("slot"), F.col(b).alias("level")).agg(F.count(F.lit(1)).alias("sales"), F.sum(w).alias("rows")), "cells")
    sums = above(cells).select(F.col("slot").alias(a), F.col("level").alias(b), F.col("s").alias("n_sales"), F.col("r").alias("n_rows"))
    # rows without a cell go by another way, else they would all meet in the partition of null
    rest = named.where(F.col(a).isNull() | F.col(b).isNull()).withColumns({"n_sales": F.lit(None).cast("long"), "n_rows": F.lit(None).cast("long")})
    return whole.join(sums.hint("merge"), [a, b]).select(*keep.columns, "n_sales", "n_rows").unionByName(rest.select(*keep.columns, "n_sales", "n_rows"))


def minutes(sales: DataFrame, at: str, seconds: int = SECONDS) -> Column:
    """Whole seconds since 1970 over so many seconds, rounded down; a time without a zone is UTC, whatever the session's zone."""
    t = F.col(at)
    if dict(sales.dtypes)[at] == "timestamp":
        whole = F.unix_seconds(t)
    else:
        t = t.cast("timestamp_ntz")
        whole = F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return F.floor(whole / seconds).cast("long")


def levels(amount: Column, cents: int = CENTS) -> Column:
    """Hundredths, rounded to the nearest, in steps of so many; null where the amount is null, no number or beyond 64 bits."""
    hundredths = F.floor(F.when(F.abs(amount) < 9e16, F.lit(100.0) * amount) + F.lit(0.5))
    return F.floor(hundredths.cast("double") / F.lit(float(cents))).cast("long")


def sale_points(sales: DataFrame) -> DataFrame:
    """sale_id, slot, level and weight, the equal rows that a sale stands for; a sale without an id stands for one."""
    copies = 1 + F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(0)) % COPIES
    return sales.select("sale_id", minutes(sales, "sold_at").alias("slot"), levels(F.col("total").cast("double")).alias("level"), copies.alias("weight"))


def op11_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = dominance_counts(sale_points(table(spark, sf_dir, "sales")), weight="weight")
    return counted.select("sale_id", "slot", "level", "n_sales", "n_rows")


# crc32 bit by bit: a byte is xored in, then eight single steps follow it
OP11_SQL = f"""
WITH b AS (
  SELECT row_number() OVER () AS id, sale_id, CAST(floor(epoch(sold_at) / {SECONDS}) AS BIGINT) AS slot,
         CAST(floor(floor(100 * total + 0.5) / {CENTS}) AS BIGINT) AS level,
         flatten(list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps
  FROM sales),
s AS (
  SELECT id, sale_id, slot, level, 1 + xor(4294967295, list_reduce(steps, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
         WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(4294967295 AS BIGINT))) % {COPIES} AS w
  FROM b),
c AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
a AS (
  SELECT c.slot, c.level, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS n_sales, CAST(coalesce(sum(d.w), 0) AS BIGINT) AS n_rows
  FROM c LEFT JOIN c AS d ON d.slot < c.slot AND d.level > c.level GROUP BY ALL)
SELECT sale_id, s.slot, s.level, n_sales, n_rows FROM s LEFT JOIN a ON s.slot = a.slot AND s.level = a.level
"""
