"""Removal of every byte that a repeated string of fixed length covers.

Which strings are compared where: each string of ``length`` bytes is assigned to its anchor, the
piece of ANCHOR bytes in it whose hash is smallest (the first of equals). Equal strings have equal
anchors at equal places, so only strings with the same anchor have to meet. The starts that share an
anchor occurrence form a stretch of the text, and the stretch with the bytes its strings need is the
anchor's context. Equal contexts are counted before they move and one of them goes on; an anchor with
one context is settled by that count.

What remains is decided on a suffix array: the contexts of a group of anchors are concatenated, the
suffixes ordered, and the Burrows-Wheeler transform extended backwards breadth first. Step n derives
all common prefixes of value n, so stopping after ``length`` steps leaves exactly the neighbours
undecided whose common prefix is at least that long.

An anchor with more contexts than CROWD is first cut: its stretches are parted by the distance to
the anchor, and each piece is keyed by the bytes that all its strings share. Pieces whose key is
unique have no repeated string, equal pieces count as contexts do, and groups of at most CROWD go to
a suffix array. The rest is cut again until it is small or a piece has one start; no group grows
with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_views, forget, materialize, release, row_key, stored, table

LENGTH, ANCHOR = 400, 80
#: Bytes whose hashes are in memory at once; contexts of one anchor that are ordered together at
#: most; bytes of contexts in one suffix array.
CHUNK, CROWD, TOGETHER = 1 << 20, 512, 1 << 19
#: Bytes of contexts that one task orders, suffix array after suffix array, up to so many tasks.
TASK_BYTES, MOST_TASKS = 8 << 20, 50_000
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64 to the powers 0 to n."""
    if len(_powers.get("up", ())) < n:
        for name, x in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _powers[name] = np.cumprod(np.r_[np.uint64(1), np.full(n, x, dtype=np.uint64)])
    return _powers["up"], _powers["down"]


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of each piece of so many bytes."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
        h = (sums[size:] - sums[:-size]) * down[: len(data) - size + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of x, from block-wise running minima in both directions."""
    n = len(x) - width + 1
    pad = -len(x) % width
    full = np.r_[x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)].reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, length: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last start of each stretch of strings with one anchor occurrence, that occurrence's place and hash, CHUNK starts at a time."""
    n = len(data) - length + 1
    for c in range(0, max(n, 0), CHUNK):
        part = data[c : min(c + CHUNK, n) + length - 1]
        h = rolling(part, anchor)
        at = np.arange(len(h), dtype=np.uint64)
        low = sliding_min((h & ~np.uint64(0xFFFFFF)) | at, length - anchor + 1) & np.uint64(0xFFFFFF)
        cut = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        place = low[cut].astype(np.int64)
        yield cut + c, np.r_[cut[1:], len(low)] - 1 + c, place + c, h[place]


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of t in the order of their first symbols, at least depth of them, by doubling."""
    n = len(t)
    wide = np.r_[t.astype(np.int64), np.zeros(8, dtype=np.int64)]
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = key * 258 + wide[k : k + n]
    known = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[1, ranked[1:] != ranked[:-1]])
        if known >= depth or rank[order[-1]] == n:
            return order
        after = np.zeros(n, dtype=np.int64)
        after[: n - known] = rank[known:]
        key = rank * (n + 1) + after
        known *= 2


def long_runs(order: np.ndarray, t: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix array whether a common prefix under length parts it from the one before.

    Breadth-first backward extension: the intervals of all strings of n symbols give those of n + 1.
    An interval's right border gets its value at the first step that reaches it, and only then is the
    interval extended further. Symbols 0 and 1 end a text and are not extended by.
    """
    n = len(t)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    bwt, back = t[order - 1], rank[order - 1]
    first = t[order]
    parted = np.zeros(n + 1, dtype=bool)
    right = np.r_[np.flatnonzero(first[1:] != first[:-1]) + 1, n]
    left = np.r_[0, right[:-1]]
    parted[right] = parted[0] = True
    for _ in range(1, length):
        size = right - left
        which = np.repeat(np.arange(len(left)), size)
        at = np.arange(len(which)) + np.repeat(left - np.r_[0, np.cumsum(size)[:-1]], size)
        real = bwt[at] > 1
        pairs = np.sort(back[at[real]] << 32 | which[real])
        if not len(pairs):
            break
        to, which = pairs >> 32, pairs & 0xFFFFFFFF
        new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (to[1:] != to[:-1] + 1) | (first[to[1:]] != first[to[:-1]])])
        left, right = to[new], np.r_[to[new[1:] - 1], to[-1]] + 1
        open_ = ~parted[right]
        left, right = left[open_], right[open_]
        parted[right] = True
        if not len(left):
            break
    return parted[:n]


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of strings of this length that start somewhere else in the texts too."""
    sizes = np.array([len(x) for x in texts])
    t = np.zeros(sizes.sum() + len(texts) + 1, dtype=np.uint16)
    begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
    fits = np.zeros(len(t), dtype=bool)
    for b, x in zip(begin.tolist(), texts, strict=True):
        t[b : b + len(x)] = np.frombuffer(x, dtype=np.uint8).astype(np.uint16) + 2
        t[b + len(x)] = 1
        fits[b : b + max(0, len(x) - length + 1)] = True
    order = suffix_order(t, length)
    run = np.cumsum(long_runs(order, t, length)) - 1
    full = fits[order]
    again = full & (np.bincount(run[full], minlength=run[-1] + 1)[run] > 1)
    hit = np.zeros(len(t), dtype=bool)
    hit[order[again]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def as_ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist(), strict=True))


def two(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


#: c: how often the stretch's context occurs in its text; 0 for a run of starts a to b that occur twice in the text.
REGION = "file long, pos long, a long, b long, p long, anchor long, r1 long, r2 long, c long"


def text_regions(view: memoryview, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """a, b, p, anchor, r1, r2, c: each context of a text once, and the starts of those that it has several times in merged runs.

    So a text that repeats itself over and over has few rows, however long it is.
    """
    parts, runs = [], []

    def once(a, b, p, h, marks, c):
        """The contexts of these stretches once, with summed counts; the starts of contexts that occur twice go to runs."""
        order = np.lexsort((marks[:, 1], marks[:, 0]))
        new = np.r_[True, (marks[order[1:]] != marks[order[:-1]]).any(axis=1)]
        of, first = np.empty(len(order), dtype=np.int64), order[new]
        of[order] = np.cumsum(new) - 1
        total = np.bincount(of, weights=c).astype(np.int64)
        again = (total[of] > 1) & (c == 1)  # others are in runs already
        if again.any():
            lo, hi = a[again], b[again]
            order = np.argsort(lo)
            lo, hi = lo[order], hi[order]
            new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1] + 1])
            runs.append(np.stack([lo[new], hi[np.r_[new[1:], len(lo)] - 1]], axis=1))
        return a[first], b[first], p[first], h[first], marks[first], total

    for first, last, place, h in stretches(np.frombuffer(view, dtype=np.uint8), length, anchor):
        digests = [xxhash.xxh3_128_digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        part = first, last, place, h, np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2), np.ones(len(first), dtype=np.int64)
        parts.append(part if len(set(digests)) == len(digests) else once(*part))  # most texts repeat nothing
    if not parts:
        return (np.empty(0, dtype=np.int64),) * 7
    a, b, p, h, marks, c = parts[0] if len(parts) == 1 else once(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    if not runs:
        return a, b, p, h.view(np.int64), marks[:, 0].copy(), marks[:, 1].copy(), c
    run = np.concatenate(runs)
    none = np.zeros(len(run), dtype=np.int64)
    return np.r_[a, run[:, 0]], np.r_[b, run[:, 1]], np.r_[p, none], np.r_[h.view(np.int64), none], np.r_[marks[:, 0], none], np.r_[marks[:, 1], none], np.r_[c, none]


def regions_of(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """The stretches of each document (file, pos, text) with their anchor's hash and their context's 128-bit hash, as REGION."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, pos, view in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_views(batch.column(2)), strict=True):
                found = text_regions(view, length, anchor)
                if n := len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, file)), pa.array(np.full(n, pos)), *map(pa.array, found)], ["file", "pos", "a", "b", "p", "anchor", "r1", "r2", "c"])

    return docs.mapInArrow(each, REGION)


def contexts_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, r1, r2, n, m, at, context: the bytes of wanted stretches (file, pos, a, b, p, anchor, r1, r2, n, m) and the anchor's place in them."""
    carried = ["anchor", "r1", "r2", "n", "m"]
    lists = wanted.groupBy("file", "pos").agg(F.collect_list(F.struct("a", "b", "p", *carried)).alias("parts"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for view, parts in zip(byte_views(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                rows += [(*(p[c] for c in carried), p["p"] - p["a"], bytes(view[p["a"] : p["b"] + length])) for p in parts]
                if len(rows) > 10_000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    def packed(rows: list) -> pa.RecordBatch:
        *numbers, context = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(context, pa.binary())], [*carried, "at", "context"])

    return docs.join(lists, ["file", "pos"]).select("text", "parts").mapInArrow(each, "anchor long, r1 long, r2 long, n long, m long, at long, context binary")


PARTS = 4


def cut_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """Cut each piece (r1, r2, n, at, cuts, context) in PARTS by the distance c1..c2 of starts before their anchor; cuts has all pieces of a context.

    k1, k2 are the hash of the bytes that all strings at these distances share, wherever a stretch
    ends, so equal strings get equal keys; e1, e2 are the hash of the bytes of the starts lo..hi that
    the piece really has.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2, n, at, cuts = (batch.column(k).to_pylist() for k in range(5))
            rows = []
            for k, view in enumerate(byte_views(batch.column(5))):
                for c in cuts[k]:
                    edges = np.unique(np.linspace(c["c1"], c["c2"] + 1, PARTS + 1).astype(int)).tolist()
                    for x, y in zip(edges, edges[1:], strict=False):
                        lo, hi = max(0, at[k] - y + 1), min(len(view) - length, at[k] - x)
                        if lo <= hi:
                            shared, own = view[at[k] - x : at[k] - y + 1 + length], view[lo : hi + length]
                            rows.append((r1[k], r2[k], n[k], x, y - 1, lo, hi, *two(xxhash.xxh3_128_digest(shared)), *two(xxhash.xxh3_128_digest(own))))
            cols = list(zip(*rows, strict=True)) or [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["r1", "r2", "n", "c1", "c2", "lo", "hi", "k1", "k2", "e1", "e2"])

    kinds = ", ".join(f"{c} long" for c in ("r1", "r2", "n", "c1", "c2", "lo", "hi", "k1", "k2", "e1", "e2"))
    return pieces.select("r1", "r2", "n", "at", "cuts", "context").mapInArrow(each, kinds)


def ordered_groups(members: DataFrame, length: int) -> DataFrame:
    """e1, e2, lo, hi: the runs of repeated starts in each member (k1, k2, e1, e2, n, piece) of groups with one k1, k2.

    Members of some groups are put into one suffix array; strings of different groups cannot be equal.
    A member that stands for n > 1 equal ones only takes part: all its starts are known to repeat.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, size = [], None, 0

        def settle() -> pa.RecordBatch:
            out = [(e1, e2, a, b) for (_, _, e1, e2, n, _), x in zip(held, repeated_starts([h[5] for h in held], length), strict=True) if n == 1 for a, b in as_ranges(x)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, ["e1", "e2", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if size > TOGETHER and key != row[:2]:
                    yield settle()
                    held, size = [], 0
                key = row[:2]
                held.append(row)
                size += len(row[5])
        if held:
            yield settle()

    total = members.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    dealt = members.select("k1", "k2", "e1", "e2", "n", "piece").repartition(min(MOST_TASKS, total // TASK_BYTES + 1), "k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.mapInArrow(each, "e1 long, e2 long, lo long, hi long")


def settled(contexts: DataFrame, length: int, anchor: int, crowd: int) -> DataFrame:
    """r1, r2, runs (lo, hi): the runs of repeated starts in contexts (anchor, r1, r2, n, m, at, context; all distinct, m to an anchor)."""
    few = contexts.where(F.col("m") <= crowd).select(F.col("anchor").alias("k1"), F.lit(0).alias("k2"), F.col("r1").alias("e1"), F.col("r2").alias("e2"), "n", F.col("context").alias("piece"))
    out = [materialize(ordered_groups(few, length).select(F.col("e1").alias("r1"), F.col("e2").alias("r2"), "lo", "hi"), "runs")]
    contexts = contexts.where(F.col("m") > crowd)
    whole = F.struct(F.lit(0).cast("long").alias("c1"), F.lit(length - anchor).cast("long").alias("c2"))
    pieces = contexts.withColumn("cuts", F.array(whole))
    while not pieces.isEmpty():
        cuts = materialize(cut_pieces(pieces, length), "cuts")
        same = cuts.groupBy("k1", "k2", "e1", "e2").agg(F.sum("n").alias("total"), F.min(F.struct("r1", "r2", "c1", "c2", "lo", "hi")).alias("rep"))
        same = materialize(same, "same")
        several = same.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        # a context that stands for several is known to repeat as a whole
        out.append(cuts.where("n = 1").join(same.where("total > 1").select("e1", "e2"), ["e1", "e2"], "left_semi").select("r1", "r2", "lo", "hi"))
        met = same.join(several.where(F.col("m") <= crowd), ["k1", "k2"]).select("k1", "k2", "e1", "e2", F.col("total").alias("n"), "rep.*")
        met = met.groupBy("r1", "r2").agg(F.collect_list(F.struct("k1", "k2", "e1", "e2", "n", "lo", "hi")).alias("p"))  # at most one for each start of a context
        met = met.join(contexts.select("r1", "r2", "context"), ["r1", "r2"]).select("context", F.explode("p").alias("p")).select("context", "p.*")
        met = materialize(met.select("k1", "k2", "e1", "e2", "n", F.expr(f"substring(context, cast(lo + 1 as int), cast(hi - lo + {length} as int))").alias("piece")), "pieces")
        found = ordered_groups(met, length).select("e1", "e2", F.col("lo").alias("x"), F.col("hi").alias("y"))
        out.append(cuts.join(found, ["e1", "e2"]).select("r1", "r2", (F.col("lo") + F.col("x")).alias("lo"), (F.col("lo") + F.col("y")).alias("hi")))
        crowded = cuts.join(same.join(several.where(F.col("m") > crowd), ["k1", "k2"]).select("e1", "e2").distinct(), ["e1", "e2"], "left_semi")
        left = crowded.groupBy("r1", "r2").agg(F.collect_list(F.struct("c1", "c2")).alias("cuts"))
        pieces = materialize(left, "crowded").join(contexts, ["r1", "r2"])
    every = reduce(DataFrame.unionByName, out)
    return every.groupBy("r1", "r2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


def kept_bytes(text: memoryview, ranges: list[tuple[int, int]], length: int) -> tuple[bytes, int]:
    """The bytes that no repeated string covers, and the number of removed runs."""
    gone = np.zeros(len(text) + 1, dtype=np.int32)
    for lo, hi in ranges:
        gone[lo] += 1
        gone[hi + length] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    runs = int((np.diff(np.r_[0, covered.astype(np.int8)]) == 1).sum())
    return np.frombuffer(text, dtype=np.uint8)[~covered].tobytes(), runs


def substring_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256.

    Rows are told apart by file and place in the file, as ids may be null or repeated, so it does
    not matter how often and in which splits the table is read; a docs that is not a plain scan of
    files is first written to the shared folder. Null texts count as empty; texts shorter than
    length have no such string and stay. Copies of a text of that length lose everything. A text that
    repeats itself gives rows for its different stretches only, so a very long one needs little more memory than its bytes. Other
    columns are ignored, whatever their names. Empty in, empty out.
    """
    spark = docs.sparkSession
    docs = stored(docs, "docs")
    key = row_key(docs)
    rows = docs.select(*key, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    regions = materialize(regions_of(rows.select("file", "pos", "text"), length, anchor), "regions")
    uniq = regions.where("c > 0").groupBy("anchor", "r1", "r2").agg(F.sum("c").alias("n"), F.min(F.struct("file", "pos", "a", "b", "p")).alias("rep"))
    uniq = materialize(uniq, "contexts")
    release(spark)
    mixed = uniq.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    wanted = uniq.join(mixed, "anchor").select("rep.*", "anchor", "r1", "r2", "n", "m")
    contexts = materialize(contexts_of(rows.select("file", "pos", "text"), wanted, length), "texts")
    release(spark)
    single = settled(contexts, length, anchor, crowd)
    spans = materialize(single, "spans")
    forget(contexts)
    release(spark)
    copied = uniq.where("n > 1").select("r1", "r2")
    whole = regions.where("c = 1").join(copied, ["r1", "r2"], "left_semi").unionByName(regions.where("c = 0")).select("file", "pos", F.col("a").alias("lo"), F.col("b").alias("hi"))
    partly = regions.where("c = 1").join(spans, ["r1", "r2"]).select("file", "pos", "a", F.explode("runs").alias("r")).select("file", "pos", (F.col("a") + F.col("r.lo")).alias("lo"), (F.col("a") + F.col("r.hi")).alias("hi"))
    ranges = whole.unionByName(partly).groupBy("file", "pos").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    ranges = materialize(ranges, "ranges")
    forget(regions)
    forget(uniq)
    forget(spans)
    release(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for view, found in zip(byte_views(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, runs = kept_bytes(view, [(r["lo"], r["hi"]) for r in found or ()], length)
                made.append((len(view), len(view) - len(kept), runs, kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*made, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.join(ranges, ["file", "pos"], "left").select("doc_id", "text", "ranges").mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")
