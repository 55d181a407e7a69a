"""One document of each group of near copies: fingerprints and bands propose pairs, the five-word shingles judge them.

Two documents are near copies if their five-word shingles have a Jaccard similarity of 0.8 or more.
SimHash fingerprints of the shingles, linked by their deletion variants, propose the copies that
differ in scattered words. They cannot find the others: with a tenth of a text appended or cut off
fingerprints differ in about six bits, beyond what halves with one wildcard reach. So each document
is besides entered under BANDS keys of ROWS smallest hashes each; at a similarity of 0.8 two
documents share one of the keys with a probability of 0.9993, above that with more.

A key's documents first meet its smallest doc_id only, under a few keys and then under more; what has a
near copy that stays is dropped, which ends large groups. Keys that few of the documents left share give
all their pairs. Documents under a key that many still share, such as letters made from one template, which
are alike but not alike enough, are compared by rare shingles instead of by that key: with shingles
ordered by frequency, a text and a longer one at 0.8 share one of the rarest ninth of the shorter and
the rarest fifth of the longer, the first that they share leaves enough behind it in both, and few of 1024
parities of their hashes differ; they meet under the first that they share. What each letter has for itself stands first, so unlike letters
do not meet, and no pair at 0.8 among them is lost. No pair is judged twice.

Decisions go by rising doc_id: a document with a near copy among those that stay is dropped, any
other stays. So every dropped document has a near copy among those kept, no two of those kept are
known to be near copies, and no chain of small changes drops a text that is far from all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_views, forget, fresh, materialize, release, texts
from .simhash import components, links, majority

WORDS, SIMILARITY = 5, 0.8
#: Keys of a document and smallest hashes in each; how many of the keys the rounds with one leader a key have looked at by their end.
BANDS, ROWS, LEADING = 24, 6, (4, 12)
#: Documents under one key, up to which all pairs are judged.
CLOSE = 4
#: Bits by which two sets are held against each other before they are compared, and rarer shingles by which two documents tell that they met before.
PARITIES, BEFORE = 1024, 64
#: Shingles hashed at once for the bands; links of a component that one task may decide; steps before components are looked for.
CHUNK, SMALL, PEEL = 4096, 4096, 6
_rng = np.random.default_rng(20)
MASKS = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
MULTIPLIERS = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of all runs of so many words, in order; a shorter text is one run, an empty one the run of no words."""
    parts = text.lower().split()
    joined, size = b" ".join(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined)], dtype=np.uint64)
    starts, stops = (ends - size).tolist(), ends[words - 1 :].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(starts, stops, strict=False)), dtype=np.uint64, count=len(stops)))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Jaccard similarity of two sorted sets of at least so much."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def band_keys(own: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes, each mixed from ROWS minima under hash functions of its own."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(own), CHUNK):
            low = np.minimum(low, ((own[k : k + CHUNK, None] ^ MASKS) * MULTIPLIERS).min(axis=0))
        out = np.arange(BANDS, dtype=np.uint64)
        for row in low.reshape(ROWS, BANDS):
            out = (out ^ row) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, fp (SimHash of the distinct shingles) and keys of each document, from one pass over the texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(bytes(x)) for x in byte_views(b.column(1))]
            fp = np.array([majority(x) for x in own], dtype=np.uint64).view(np.int64)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([band_keys(x) for x in own] or [np.empty(0, np.uint64)]).view(np.int64)), BANDS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), keys.cast(pa.list_(pa.int64()))], ["doc_id", "fp", "keys"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, fp long, keys array<long>")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v of the pairs whose shingles are similar, u < v."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(bytes(x)).tobytes() for x in byte_views(b.column(1))], pa.binary())], ["id", "own"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = ([np.frombuffer(bytes(x), dtype=np.uint64) for x in byte_views(b.column(k))] for k in (2, 3))
            near = pa.array([similar(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(near)

    met = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = materialize(docs.join(met, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(each, "id long, own binary"), "sets")
    one, two = sets.select(F.col("id").alias("u"), F.col("own").alias("a")), sets.select(F.col("id").alias("v"), F.col("own").alias("b"))
    out = materialize(pairs.join(two, "v").join(one, "u").select("u", "v", "a", "b").mapInArrow(judge, "u long, v long").distinct(), "similar")
    forget(sets)
    return out


def settle(edges: DataFrame) -> DataFrame:
    """doc_id of the documents dropped when they are taken by rising doc_id, a component at a time. edges: u, v with u < v."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gone = None, set()
        for b in batches:
            out = []
            for root, u, v in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if root != at:
                    at, gone = root, set()
                if u not in gone and v not in gone:
                    gone.add(v)
                    out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["doc_id"])

    placed = edges.join(components(edges).withColumnRenamed("node", "v"), "v").select("root", "u", "v")
    return placed.repartition("root").sortWithinPartitions("root", "v", "u").mapInArrow(each, "doc_id long")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges (u, v) with neither end among gone (doc_id)."""
    for c in ("u", "v"):
        edges = edges.join(gone.select(F.col("doc_id").alias(c)), c, "left_anti")
    return edges.select("u", "v")


def decided(edges: DataFrame) -> DataFrame:
    """doc_id of the documents dropped when they are taken by rising doc_id. edges: u, v with u < v.

    A document without a smaller neighbour stays and its neighbours go, all such at once: that ends
    large groups around one text at the first step. Chains that are left are settled by component,
    after more such steps if one has over SMALL links.
    """
    out = []
    while True:
        for _ in range(PEEL):
            heads = edges.select(F.col("u").alias("doc_id")).distinct().join(edges.select(F.col("v").alias("doc_id")), "doc_id", "left_anti")
            gone = materialize(edges.join(heads.withColumnRenamed("doc_id", "u"), "u", "left_semi").select(F.col("v").alias("doc_id")).distinct(), "gone")
            out.append(gone)
            edges = materialize(without(edges, gone), "left")
            if edges.isEmpty():
                return union(out)
        release(edges.sparkSession)
        roots = components(edges).withColumnRenamed("node", "v")
        most = edges.join(roots, "v").groupBy("root").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if most <= SMALL:
            return union([*out, materialize(settle(edges), "settled")])


def simhash_pairs(sketch: DataFrame) -> DataFrame:
    """u, v of documents whose fingerprints are equal or linked: each with the smallest of its fingerprint, and these with one another."""
    lows = sketch.groupBy("fp").agg(F.min("doc_id").alias("low"))
    same = sketch.join(lows, "fp").where("doc_id <> low").select(F.col("low").alias("u"), F.col("doc_id").alias("v"))
    near = links(lows.select("fp"))
    named = lambda c: lows.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_id"))
    near = near.join(named("u"), "u").join(named("v"), "v").select(F.least("u_id", "v_id").alias("u"), F.greatest("u_id", "v_id").alias("v"))
    return same.unionByName(near)


def led_pairs(posts: DataFrame) -> DataFrame:
    """u, v: the smallest doc_id under each key with all others. posts: key, doc_id."""
    lead = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("u")).where("n > 1")
    return posts.join(lead, "key").where("doc_id <> u").select("u", F.col("doc_id").alias("v"))


def parities(own: np.ndarray) -> np.ndarray:
    """PARITIES bits: whether a set has an odd number of hashes with each remainder. Sets differ in at least as many hashes as their bits differ."""
    odd = np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, own (shingles) and bits (their parities) of documents (doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(bytes(x)) for x in byte_views(b.column(1))]
            bits = [parities(x) for x in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "own", "bits"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, own array<long>, bits array<long>")


def meetings(sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """u, v: documents (as shingle_sets() has them) that meet under a rare shingle, all pairs of that similarity or more among them.

    A pair meets under the rarest shingle that it shares; later ones see that by the BEFORE rarest of each document and
    do not make it again. Only if that first one lies beyond these in a long text is the pair made more than once.
    """
    rows = sets.select("doc_id", F.size("own").alias("n"), F.explode("own").alias("h"))
    # a shingle of one document only takes a place among the rarest, and can be left out but for that
    common = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = rows.join(common, "h").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("own")).join(sets.select("doc_id", "bits"), "doc_id")
    alone = F.col("n") - F.size("own")
    rarest = lambda share: F.slice("own", F.lit(1), F.greatest(F.lit(0), F.size("own") + 1 - F.ceil(F.col("n") * share - 1e-9).cast("int")))

    def entries(share: float, doc: str, size: str, place: str, bits: str, before: str) -> DataFrame:
        few = own.select("doc_id", "n", "bits", alone.alias("alone"), F.transform(rarest(share), lambda x: x["h"]).alias("few"))
        spread = few.select("*", F.posexplode("few").alias("k", "h"))
        rarer = F.slice("few", F.lit(1), F.least("k", F.lit(BEFORE)))
        return spread.select("h", F.col("doc_id").alias(doc), F.col("n").alias(size), (F.col("alone") + F.col("k")).alias(place), F.col("bits").alias(bits), rarer.alias(before))

    met = entries(2 * least / (1 + least), "a", "m", "p", "x", "r").join(entries(least, "b", "n", "q", "y", "s"), "h")
    both = (F.col("m") + F.col("n")) * (least / (1 + least)) - 1e-9
    # of the first shingle that two share: itself and all behind it is the most that they can share
    enough = 1 + F.least(F.col("m") - 1 - F.col("p"), F.col("n") - 1 - F.col("q")) >= both
    # and each parity that differs is a shingle that one of them has for itself
    apart = reduce(add, (F.bit_count(F.get("x", F.lit(k)).bitwiseXOR(F.get("y", F.lit(k)))) for k in range(PARITIES // 64)))
    met = met.where((F.struct("m", "a") < F.struct("n", "b")) & (F.col("m") >= F.col("n") * least - 1e-9) & enough & (apart <= F.col("m") + F.col("n") - 2 * both) & ~F.arrays_overlap("r", "s"))
    return met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def prefix_pairs(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """u, v: pairs of documents (doc_id, text) with a rare shingle in common; all pairs of that similarity or more are among them."""
    sets = materialize(shingle_sets(docs), "shingles")
    out = materialize(meetings(sets, least).distinct(), "rare")
    forget(sets)
    return out


def close_pairs(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v of documents that share a key: all pairs under a key of few documents, those with a rare shingle in common under the others."""
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posts = materialize(posts.join(sizes, "key"), "posts")
    few = posts.where(F.col("n") <= CLOSE).select("key", "doc_id")
    pairs = few.withColumnRenamed("doc_id", "u").join(few.withColumnRenamed("doc_id", "v"), "key").where("u < v").select("u", "v")
    many = materialize(posts.where(F.col("n") > CLOSE).select("doc_id").distinct(), "crowded")
    return pairs if many.isEmpty() else pairs.unionByName(prefix_pairs(docs.join(many, "doc_id", "left_semi")))


def dropped_ids(docs: DataFrame) -> DataFrame:
    """doc_id of the documents that have a near copy among those that stay. docs: doc_id, text."""
    judged, found, dropped = [], [], []

    def judge(pairs: DataFrame) -> DataFrame | None:
        """The near copies among pairs that have not been judged before; None if there are no such pairs."""
        new = materialize(reduce(lambda p, j: p.join(j, ["u", "v"], "left_anti"), judged, pairs.distinct()), "pairs")
        if new.isEmpty():
            return None
        judged.append(new)
        found.append(verified(new, docs))
        release(docs.sparkSession)  # many small joins, each with a broadcast
        return found[-1]

    sketch = materialize(sketches(docs).dropDuplicates(["doc_id"]), "sketches")
    by_key = lambda rows, a=0, b=BANDS: rows.select("doc_id", F.explode(F.slice("keys", a + 1, b - a)).alias("key"))
    rest, seen = sketch, 0
    for keys in LEADING:
        pairs = led_pairs(by_key(rest, seen, keys))
        near = judge(pairs if seen else pairs.unionByName(simhash_pairs(sketch)))
        if near is not None:
            dropped.append(decided(near))
            rest = materialize(rest.join(dropped[-1], "doc_id", "left_anti"), "rest")
        seen = keys
    near = judge(close_pairs(by_key(rest), docs))
    if near is not None:
        dropped.append(decided(near))
    if not dropped:
        return docs.select("doc_id").limit(0)
    gone = union(dropped).distinct()
    while True:
        # of what a round dropped, the documents whose near copies a later round dropped
        gone, edges = materialize(gone, "gone"), union(found)
        held = union([edges.join(gone.withColumnRenamed("doc_id", a), a, "left_anti").select(F.col(b).alias("doc_id")) for a, b in (("u", "v"), ("v", "u"))])
        lost = materialize(gone.join(held, "doc_id", "left_anti"), "lost")
        if lost.isEmpty():
            return gone
        # they are judged anew among themselves and with what stays under their keys, which goes first
        stay = materialize(gone.join(lost, "doc_id", "left_anti"), "stay")
        theirs = by_key(sketch.join(lost, "doc_id", "left_semi")).select("key").distinct()
        pairs = close_pairs(by_key(sketch.join(stay, "doc_id", "left_anti")).join(theirs, "key", "left_semi"), docs)
        end = lambda c: lost.withColumnRenamed("doc_id", c)
        judge(union([pairs.join(end(c), c, "left_semi").select("u", "v") for c in ("u", "v")]))
        live = without(union(found), stay)
        known = materialize(union([live.join(end(a), a, "left_anti").join(end(b), b, "left_semi").select(F.col(b).alias("doc_id")) for a, b in (("u", "v"), ("v", "u"))]).distinct(), "known")
        among = materialize(without(live.join(end("u"), "u", "left_semi").join(end("v"), "v", "left_semi"), known), "among")
        gone = union([stay, known, *([] if among.isEmpty() else [decided(among)])]).distinct()


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without near copies of a document that stays; all columns.

    Null texts count as empty; texts without words are copies of one another, and one of fewer than
    five words is a copy only of the same words. Rows without an id always stay. Rows that share an
    id share its fate, so exact dedup goes before. Columns of any name pass through. Empty in, empty
    out.
    """
    plain = texts(docs).where("doc_id is not null")
    (name,) = fresh(docs, 1)
    gone = materialize(dropped_ids(plain).distinct(), "gone").select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
