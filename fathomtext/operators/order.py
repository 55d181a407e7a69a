"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges, and keys drawn for each bound between them.
RANGES, DRAWN = 64, 16


def bounds(rows: DataFrame, keys: tuple[str, ...], ranges: int = RANGES) -> list:
    """Keys that cut the distinct keys into about so many ranges of about equal size, in order; drawn by hash, so always the same."""
    drawn = rows.select(*keys).distinct().orderBy(F.xxhash64(*keys), *keys).limit(ranges * DRAWN).orderBy(*keys).collect()
    return [drawn[len(drawn) * k // ranges] for k in range(1, ranges)] if len(drawn) >= ranges else drawn[1:]


def range_of(rows: DataFrame, keys: tuple[str, ...], cuts: list):
    """The number of cuts that are not after the row's key."""
    if not cuts:
        return F.lit(0)
    kinds = {f.name: f.dataType for f in rows.schema}
    of = lambda r: F.struct(*(F.lit(r[k]).cast(kinds[k]).alias(k) for k in keys))
    return F.size(F.filter(F.array(*map(of, cuts)), lambda b: b <= F.struct(*keys)))


def placed(rows: DataFrame, *keys: str, name: str = "place", ranges: int = RANGES) -> DataFrame:
    """rows with their place, 1, 2, ..., by keys in ascending order, nulls first; rows with equal keys take their places in any order.

    Ranges of about equal size are cut at keys drawn from the rows, their sizes are counted and added up,
    and places are counted within each range, so neither a common prefix nor many rows meet in one task.
    Only as many keys as there are ranges reach the driver. The rows are read three times: store them first if
    they are costly to make.
    """
    part = rows.withColumn("__r", range_of(rows, keys, bounds(rows, keys, ranges)))
    sizes = part.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = sizes.select(F.struct("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o")).alias("__x"))
    offsets = offsets.agg(F.map_from_entries(F.collect_list("__x")).alias("__m"))  # an entry a range
    within = F.row_number().over(Window.partitionBy("__r").orderBy(*keys))
    return part.withColumn("__w", within).join(F.broadcast(offsets)).withColumn(name, (F.col("__m")[F.col("__r")] + F.col("__w")).cast("long")).drop("__r", "__m", "__w")
