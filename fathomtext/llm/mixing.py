"""Mixing sources to target weights by entropy balancing.

Each source has a target in words. Among all document rates that meet the targets, between 0 and
MOST copies, the ones closest to one copy each (least relative entropy) are exponentially tilted:
rate = min(MOST, exp(t size)), with one tilt t a source, the multiplier of its constraint in the convex
dual. Newton's method solves the dual for all sources at once; every step is one aggregation. Rates
depend on source and size only, so it runs over the distinct (source, size) cells with their counts,
not over documents, and no source, however large, has to fit into one task.

Rounding keeps the words: a source's cells, largest sizes first, take whole copies so that what
rounding leaves over passes to the next cell, and the source ends within about a small document of
its target. Within a cell every document has the rounded-down rate, and the copies left go
to the documents with the smallest hashes, counted in buckets of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import forget, materialize, table

WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: How near the tilted rates come to a target, as a share of it; documents of a cell that are ranked together on average.
NEAR, BUCKET = 1e-9, 1000
#: Sources (some 100 bytes each) up to which a table of them is sent to every executor.
FEW_SOURCES = 100_000
#: Newton steps that no well-posed dual needs; bisection alone would end before.
STEPS = 200


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key(source: Column) -> Column:
    """The source as a string that sorts by code point with null last, and joins null with null."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def small(rows: DataFrame, n: int) -> DataFrame:
    """rows, broadcast if n, their number, is few."""
    return F.broadcast(rows) if n <= FEW_SOURCES else rows


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with place, 0, 1, ... by a column without repeated values: range partitions, their sizes, and places within them."""
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ordered")
    # a row a partition
    sizes = dealt.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = dealt.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part")
    return placed.withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """s, source_size, target of each source (s, source_size): shares of all words by weights, which repeat in order of s.

    A target stops at most times the source's size; the excess is shared by weight among the others until none is above.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = materialize(numbered(sources, "s").select("s", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("top")), "weighted")
    share, total, capped = 0.0, None, -1
    while True:
        # share: words for a weight of one; it only rises, so a source that has stopped stays so
        full = F.col("top") < F.col("weight") * share
        r = rows.agg(F.sum("source_size").alias("all"), F.count_if(full).alias("n"), F.sum(F.when(full, F.col("top")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if r["all"] is None or r["n"] == capped or not r["open"]:
            break
        capped, share = r["n"] if share else -1, (r["all"] - r["held"]) / r["open"]
    return rows.select("s", "source_size", F.least("top", F.col("weight") * share).alias("target"))


def tilts(cells: DataFrame, goals: DataFrame, most: float = MOST, near: float = NEAR) -> DataFrame:
    """s, mean, t of each source (goals: s, source_size, target): with rate = min(most, exp(t size / mean)) its cells (s, size, n) come to its target.

    Newton steps on the dual, all sources in one aggregation a step; a step that leaves the bracket of
    the root, or that the bound on rates makes useless, is replaced by bisection. Sources whose target is
    most times their size have an infinite tilt, sources without words none.
    """
    mean = cells.where("size > 0").groupBy("s").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = goals.join(mean, "s", "left").withColumn("done", F.col("mean").isNull() | (F.col("target") >= F.col("source_size") * most * (1 - near)))
    tilt = F.when(F.col("mean").isNull(), 0.0).when(F.col("done"), float("inf")).otherwise(0.0)
    none = F.lit(None).cast("double")
    state = materialize(state.select("s", "target", "mean", "done", tilt.alias("t"), none.alias("lo"), none.alias("hi")), "tilts")
    n = state.count()
    for _ in range(STEPS):
        open_ = state.where(~F.col("done"))
        if open_.isEmpty():
            return state.select("s", "mean", "t")
        x = F.col("size") / F.col("mean")
        tilted = F.exp(F.least(F.col("t") * x, F.lit(700.0)))
        rate, slope = F.least(tilted, F.lit(float(most))), F.when(tilted < most, tilted * x).otherwise(0.0)
        tokens = F.col("n") * F.col("size")
        sums = cells.join(small(open_.select("s", "mean", "t"), n), "s").groupBy("s").agg(F.sum(tokens * rate).alias("g"), F.sum(tokens * slope).alias("h"))
        new = state.join(sums, "s", "left")
        reached = F.col("done") | (F.abs(F.col("g") - F.col("target")) <= near * F.col("target"))
        lo, hi = F.when(F.col("g") < F.col("target"), F.col("t")).otherwise(F.col("lo")), F.when(F.col("g") > F.col("target"), F.col("t")).otherwise(F.col("hi"))
        step = F.col("t") + F.try_divide(F.col("target") - F.col("g"), F.col("h"))
        # without a bound on one side yet, a step goes at most so far
        middle = F.when(lo.isNull(), hi * 2 - 1).when(hi.isNull(), lo * 2 + 1).otherwise((lo + hi) / 2)
        usable = step.isNotNull() & (lo.isNull() | (step > lo)) & (hi.isNull() | (step < hi)) & (F.abs(step - F.col("t")) <= F.abs(F.col("t")) + 1)
        stuck = lo.isNotNull() & hi.isNotNull() & ((middle <= lo) | (middle >= hi))  # no double between them
        t = F.when(reached, F.col("t")).when(usable, step).otherwise(middle)
        held, state = state, materialize(new.select("s", "target", "mean", (reached | F.coalesce(stuck, F.lit(False))).alias("done"), t.alias("t"), lo.alias("lo"), hi.alias("hi")), "tilts")
        forget(held)
    raise ArithmeticError("the dual did not converge")


def whole_copies(cells: Iterator[pd.DataFrame], most: float) -> Iterator[pd.DataFrame]:
    """Of one source's cells (size, n, rate): copies, the whole copies of a cell together."""
    c = pd.concat(list(cells)).sort_values("size", ascending=False, kind="stable")
    size, n, rate = (c[k].to_numpy() for k in ("size", "n", "rate"))
    wanted, copies, over = size * n * rate, np.zeros(len(c), dtype=np.int64), 0.0
    for i in range(len(c)):
        if size[i]:
            over += wanted[i]
            copies[i] = min(max(0, round(over / size[i])), int(most) * n[i])
            over -= copies[i] * size[i]
        else:
            copies[i] = round(n[i] * rate[i])
    yield c.assign(copies=copies)[["s", "size", "n", "rate", "copies"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, column: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken, a row for each document, in words.

    A null text has no words; such documents and empty ones keep one copy of nothing. Null is a source
    of its own, the last. Repeated rows are documents of their own; rows without an id are ranked by their null.
    Ties between equal ids take either, which shows nowhere in the rows. Other columns, whatever their names, are ignored. An empty
    table gives an empty result. Copies are at most ``most``, so a text counts at most so often.
    """
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), key(F.col(source)).alias("s"), words(F.col(column)).alias("size")), "sizes")
    cells = materialize(rows.groupBy("s", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    goals = materialize(targets(cells.groupBy("s").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most), "targets")
    n = goals.count()
    tilt = tilts(cells, goals, most)
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.exp(F.least(F.col("t") * F.col("size") / F.col("mean"), F.lit(700.0))), F.lit(float(most))))
    rated = cells.join(small(tilt, n), "s").select("s", "size", "n", rate.alias("rate"))
    # a source's cells are its distinct sizes, of which there are at most about the root of twice its words
    whole = rated.groupBy("s").applyInPandas(lambda c: next(whole_copies(iter([c]), most)), "s string, size long, n long, rate double, copies long")
    whole = materialize(whole.select("s", "size", "rate", F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("more"), F.col("n").alias("of"), F.ceil(F.col("n") / BUCKET).alias("buckets")), "copies")
    h = F.xxhash64("doc_id", F.lit(11))
    placed = rows.join(whole, ["s", "size"]).withColumns({"h": h, "bucket": F.pmod(F.xxhash64("doc_id", F.lit(12)), F.col("buckets"))})
    placed = materialize(placed, "placed")
    # the copies left of a cell are dealt to its buckets by the share of documents so far
    sizes = placed.where("more > 0").groupBy("s", "size", "bucket").agg(F.count(F.lit(1)).alias("b"), F.first("more").alias("more"), F.first("of").alias("of"))
    so_far = F.sum("b").over(Window.partitionBy("s", "size").orderBy("bucket"))
    quota = F.floor(F.col("more") * F.col("to") / F.col("of")) - F.floor(F.col("more") * (F.col("to") - F.col("b")) / F.col("of"))
    quotas = sizes.withColumn("to", so_far).select("s", "size", "bucket", quota.alias("quota"))
    rank = F.row_number().over(Window.partitionBy("s", "size", "bucket").orderBy("h", "doc_id"))
    extra = placed.where("more > 0").join(quotas, ["s", "size", "bucket"]).withColumn("copies", F.col("each") + (rank <= F.col("quota")).cast("long"))
    plain = placed.where("more = 0").withColumn("copies", F.col("each"))
    out = plain.select("doc_id", "source", "s", "size", "rate", "copies").unionByName(extra.select("doc_id", "source", "s", "size", "rate", "copies"))
    out = out.join(small(goals, n), "s")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
