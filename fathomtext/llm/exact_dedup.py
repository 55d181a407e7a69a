"""Exact dedup against a history that is held as a minimal perfect hash.

The distinct digests of the history are cut into shards by their leading bits. Each shard becomes a
minimal perfect hash: level bit vectors in which every digest owns one bit, the number of set bits
before it being its slot. A slot holds the full 32-byte digest, the id of the row that stays and
the size of the group. New rows are first summed up per digest, then looked up: a digest counts as
a member only if all 32 bytes in its slot agree. Digests that no slot confirms form groups among
themselves.

Copies never meet in one task: they are counted before any exchange, and what a group decided goes
back to its rows by a join whose oversized partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, materialize, table, texts

#: Shards that an index should have at least, and digests that one holds on average: few only while there are few shards.
SHARDS, FEWEST_KEYS, MOST_KEYS = 256, 512, 100_000
#: Stands for a row without an id where ids are compared: it loses against any other.
NO_ID = -(2**63)
#: Bits that a level has for each digest left, and levels before the rest is kept as a plain list.
GAMMA, LEVELS = 1.5, 24


def mixed(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each digest for one level, from its second and third word."""
    with np.errstate(over="ignore"):
        h = words[:, 1] ^ (words[:, 2] * np.uint64(2 * level + 1))
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests."""

    def __init__(self, words: np.ndarray):
        self.levels: list[np.ndarray] = []
        left = words
        while len(left) and len(self.levels) < LEVELS:
            size = max(8, int(GAMMA * len(left)))
            at = mixed(left, len(self.levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[at.astype(np.int64)]]
        self.rest = {row.tobytes(): i for i, row in enumerate(left)}
        self.finish()

    def finish(self) -> None:
        self.starts = np.cumsum([0, *(int(x.sum()) for x in self.levels)])
        self.ranks = [np.cumsum(x) - 1 for x in self.levels]

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest: its own for members, any or -1 for others."""
        out = np.full(len(words), -1, dtype=np.int64)
        todo = np.arange(len(words))
        for k, bits in enumerate(self.levels):
            at = (mixed(words[todo], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.starts[k] + self.ranks[k][at[hit]]
            todo = todo[~hit]
        for i in todo if self.rest else ():
            found = self.rest.get(words[i].tobytes())
            if found is not None:
                out[i] = self.starts[-1] + found
        return out

    def pack(self) -> dict:
        return {"sizes": [len(x) for x in self.levels], "bits": [np.packbits(x).tobytes() for x in self.levels], "rest": list(self.rest)}

    @classmethod
    def unpack(cls, sizes, bits, rest) -> PerfectHash:
        self = cls.__new__(cls)
        self.levels = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=int(n)).astype(bool) for n, b in zip(sizes, bits, strict=True)]
        self.rest = {bytes(x): i for i, x in enumerate(rest)}
        self.finish()
        return self


INDEX = "shard int, sizes array<int>, bits array<binary>, rest array<binary>, digests binary, winners array<long>, counts array<long>"


def build_shard(group: pd.DataFrame) -> pd.DataFrame:
    words = as_words(group["digest"].tolist())
    index = PerfectHash(words)
    order = np.empty(len(words), dtype=np.int64)
    order[index.slots(words)] = np.arange(len(words))
    held = index.pack() | {"shard": int(group["shard"].iloc[0]), "digests": words[order].tobytes(), "winners": group["winner"].to_numpy(np.int64)[order], "counts": group["n"].to_numpy(np.int64)[order]}
    return pd.DataFrame([held], columns=["shard", "sizes", "bits", "rest", "digests", "winners", "counts"])


def look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The history's winner of each new digest, or its own; all bytes of the digest must agree."""
    winner, member = new["winner"].to_numpy(np.int64).copy(), np.zeros(len(new), dtype=bool)
    if len(new) and len(index):
        row = index.iloc[0]
        words, held = as_words(new["digest"].tolist()), np.frombuffer(row["digests"], dtype="<u8").reshape(-1, 4)
        slots = PerfectHash.unpack(row["sizes"], row["bits"], row["rest"]).slots(words)
        member = (slots >= 0) & (held[np.maximum(slots, 0)] == words).all(axis=1)
        winner[member] = np.asarray(row["winners"], dtype=np.int64)[slots[member]]
    return pd.DataFrame({"digest": new["digest"], "winner": winner, "n": new["n"], "member": member})


def sharded(df: DataFrame, shards: int) -> DataFrame:
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return df.withColumn("shard", (lead % shards).cast("int"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """history: digest, winner, n, one row for each distinct digest. One row for each shard."""
    return sharded(history.withColumn("winner", F.coalesce("winner", F.lit(NO_ID))), shards).groupBy("shard").applyInPandas(build_shard, INDEX)


def probe(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """new: digest, winner, n. Members get the history's winner; the others keep their own."""
    new = sharded(new.withColumn("winner", F.coalesce("winner", F.lit(NO_ID))), shards)
    found = new.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(look_up, "digest binary, winner long, n long, member boolean")
    return found.withColumn("winner", F.nullif("winner", F.lit(NO_ID)))


def digests(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"))


def exact_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): doc_id and digest of each row; digest, keep_id and group_size of each text.

    docs: doc_id, text. Nulls count as empty texts. Of equal texts the largest doc_id stays; a null
    id loses against any other. The upper half of the id range is the history, the lower half and
    rows without an id arrive as new, so a confirmed member never displaces a winner.
    """
    rows = materialize(digests(texts(docs), F.col("text")), "digests")
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    pivot = None if low is None else (low + high + 1) // 2
    old = F.lit(False) if pivot is None else F.coalesce(F.col("doc_id") >= pivot, F.lit(False))
    shards = max(1, -(-n // (2 * min(MOST_KEYS, max(FEWEST_KEYS, n // (2 * SHARDS))))))
    history = summed(rows.where(old))
    found = probe(summed(rows.where(~old)), build_index(history, shards), shards)
    groups = history.unionByName(found.select("digest", "winner", "n"))
    return rows, groups.groupBy("digest").agg(F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Empty tables give an empty result. Rows that repeat an id and a text all carry the same answer.
    Other columns of docs are ignored, whatever their names.
    """
    rows, groups = exact_groups(docs)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that lose, with all columns as they are; of rows that repeat id and text one stays.

    Nulls count as empty texts. A row without an id stays if no equal text has one. Empty in, empty out.
    """
    _, groups = exact_groups(docs)
    own, digest = fresh(docs, 2)
    keep = groups.select(F.coalesce("keep_id", F.lit(NO_ID)).alias(own), F.col("digest").alias(digest))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), digest: F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))})
    return seen.join(keep, [own, digest], "left_semi").dropDuplicates([own, digest]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
