"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most three bits,
one half differs in at most one. So each half is indexed under its 32 variants with one bit
position blanked; equal variants meet, and each meeting is verified on the whole fingerprints.

Only distinct fingerprints are indexed, so copies cost nothing. The members of a variant are linked
by a search from one to the next, which yields a spanning forest instead of all pairs: at most one
link for each member, and no component is lost. A half that very many fingerprints share would
make a large bucket; such halves are counted beforehand, and their buckets are cut a second time by
the same rule on the other half (two quarters of 16 bits). A bucket of the second level leaves 18
bits open, so it holds at most 2^18 fingerprints, however large the input; the task that has it
cuts it again by the same rule until no part is large.

Links become components by rounds of large-star and small-star steps on tables in the shared
folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_views, forget, materialize, table, texts

BITS, WORDS, SEED = 3, 3, 42
#: Shingles whose bits are summed at once, and fingerprints in a bucket before it is cut again.
BLOCK, CROWD = 1 << 16, 2048


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority of the bits of the XXH64 of all word shingles; zero without words. A-Z only are lower-cased."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined, size = b" ".join(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(parts) - words + 1)
    stops = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, BLOCK):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK].tolist(), stops[k : k + BLOCK].tolist(), strict=False)), dtype="<u8", count=min(BLOCK, n - k))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(bytes(x), words) for x in byte_views(b.column(1))), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(each, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """fp, key: the 64 one-wildcard variants, numbered by half and blanked bit."""
    half = lambda i: F.shiftrightunsigned("fp", 32 * i).bitwiseAND(F.lit(0xFFFFFFFF))
    keys = [F.lit((64 * i + j) << 32).bitwiseOR(half(i).bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << j)))) for i in (0, 1) for j in range(32)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def crowded(fps: DataFrame, crowd: int) -> DataFrame:
    """The variants that may have over crowd members, from counts of whole halves (two rows a fingerprint).

    A bucket is the union of two halves' members, so one of them has over crowd / 2.
    """
    half = lambda i: F.shiftrightunsigned("fp", 32 * i).bitwiseAND(F.lit(0xFFFFFFFF))
    halves = fps.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), half(i).alias("v")) for i in (0, 1)))).alias("h")).select("h.*")
    warm = halves.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd // 2)
    keys = [((F.col("i") * 64 + j).cast("long") * (1 << 32)).bitwiseOR(F.col("v").bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << j)))) for j in range(32)]
    return warm.select(F.explode(F.array(*keys)).alias("key")).distinct()


def second_level(hot: DataFrame) -> DataFrame:
    """fp, key, sub: the other half's two quarters, each with one of its 16 bits blanked or none needed."""
    other = F.when(F.col("key") < (64 << 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp")).bitwiseAND(F.lit(0xFFFFFFFF))
    quarter = lambda i: F.shiftrightunsigned(other, 16 * i).bitwiseAND(F.lit(0xFFFF))
    subs = [F.lit((16 * i + j) << 16).bitwiseOR(quarter(i).bitwiseAND(F.lit(0xFFFF & ~(1 << j)))) for i in (0, 1) for j in range(16)]
    return hot.select("fp", "key", F.explode(F.array(*subs)).alias("sub"))


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(members: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between fingerprints at most so many bits apart that connect whatever such links connect."""
    out, left, queue = [], members, []
    while len(left) or queue:
        if not queue:
            if len(left) < 2:
                break
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = ones(left ^ at) <= bits
        if near.any():
            found = left[near]
            out.append((np.full(len(found), at, dtype=np.uint64), found))
            queue.extend(found)
            left = left[~near]
    return out


def joined(members: np.ndarray, bits: int, crowd: int = CROWD) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for a bucket of any size: a large one is indexed again, until no part is large.

    The bit positions in which the members differ at all are cut into two halves. Of two members at
    most three bits apart one half differs in at most one, so they share a variant that blanks one
    position of it. A part holds at most the members that the other half leaves open, so parts shrink.
    """
    differ = int(np.bitwise_or.reduce(members ^ members[0]))
    places = [k for k in range(64) if differ >> k & 1]
    if len(members) <= crowd or bits > 3 or len(places) < 6:
        return forest(members, bits)
    out = []
    for half in (places[: len(places) // 2], places[len(places) // 2 :]):
        for blank in half:
            key = members & np.uint64(sum(1 << k for k in half if k != blank))
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a > 1:
                    part = members[order[a:b]]
                    out += forest(part, bits) if b - a == len(members) else joined(part, bits, crowd)
    return out


def linked(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """u, v: the forest of each bucket. rows: keys and fp; one bucket is in memory at a time."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def close() -> list[tuple[np.ndarray, np.ndarray]]:
            members = np.concatenate(held) if held else np.empty(0, dtype=np.uint64)
            return joined(members, bits) if len(members) > 1 else []

        for b in batches:
            k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))], axis=1)
            fp = b.column(len(keys)).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
            ends, out = np.r_[starts[1:], len(fp)], []
            size = ends - starts
            first, last = tuple(k[0]), tuple(k[-1])
            if held_key is not None and held_key != first:
                out += close()
                held = []
            inner = np.ones(len(starts), dtype=bool)
            inner[-1] = False
            if held_key == first:
                held.append(fp[: ends[0]])
                if len(starts) > 1:
                    out += close()
                    held, inner[0] = [], False
            two = starts[inner & (size == 2)]
            near = ones(fp[two] ^ fp[two + 1]) <= bits
            out.append((fp[two[near]], fp[two[near] + 1]))
            for i in np.flatnonzero(inner & (size > 2)):
                out += joined(fp[starts[i] : ends[i]], bits)
            if not (held_key == first and len(starts) == 1):
                held = [fp[starts[-1] :]]
            held_key = last
            u, v = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        out = close()
        if out:
            u, v = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(runs, "u long, v long")


def links(fps: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """u, v: links that connect all fingerprints at most three bits apart. fps: distinct fp."""
    if bits > 3:
        raise ValueError("two halves find at most three differing bits")
    hot = materialize(crowded(fps, crowd), "crowded")
    n = hot.count()
    every = variants(fps)
    if not n:
        return linked(every, ["key"], bits)
    keys = F.broadcast(hot) if n <= 100_000 else hot  # 8 bytes a key
    cool = linked(every.join(keys, "key", "left_anti"), ["key"], bits)
    return cool.unionByName(linked(second_level(every.join(keys, "key", "left_semi")), ["key", "sub"], bits))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches. edges: u, v."""
    tidy = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = materialize(tidy(edges), "edges"), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(tidy(large), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").unionByName(low.select(F.col("u").alias("v"), "m"))
        after = materialize(tidy(small.select(F.col("v").alias("u"), F.col("m").alias("v"))), "small")
        forget(now)
        forget(large)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id of each row.

    Component ids are the smallest doc_id reachable; a null id never is one unless all are null.
    Texts without words have fingerprint zero and are linked like any other. Null texts count as
    empty. Rows that repeat get the same answer. Other columns are ignored. Empty in, empty out.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    lows = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(lows.select("fp"), bits))
    placed = lows.join(roots, lows["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "placed")
    smallest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
