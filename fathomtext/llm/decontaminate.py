"""Benchmark decontamination with suffix arrays over the training documents.

A shard is one Arrow batch of documents. Its words are numbered by the benchmark's vocabulary; every
other word is a wall that no match crosses. The shard's suffix array holds the suffixes that begin
inside a stretch of benchmark words and whose first two words stand side by side in the benchmark:
no other suffix can match. It is ordered by as many words as a window has. Every
suffix of every benchmark item is then binary-searched in it, all of them at once, one word deeper
in each round, which narrows each to the range of locations of its window. Equal windows are
searched once, and items are looked up by window afterwards, so neither equal items nor frequent
passages multiply. The found stretches and the items in them then go into one suffix array of full
depth: the neighbours there give the longest verbatim match and its places in document and item.

The benchmark is the stated query set: it is read in blocks of bounded size, and each block meets
all documents. Documents are never gathered, and one block at a time is in the workers' memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_views, fresh, materialize, prepare, row_key, stored, table

WINDOW = 10
#: Bytes of benchmark text that one block holds on average; at most about twice as many are sent to every executor. Item names in one batch of results.
BLOCK_BYTES, NAMES = 8 << 20, 100_000
#: A-Z become a-z; digits, letters and all bytes of non-ASCII characters stay; the rest separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Benchmark:
    """A block: the words of its distinct texts on end, a wall after each, and the distinct windows in them.

    Only the words, their numbers and the items' names travel (about as many bytes as the text has); all
    else is made from them, in flat arrays, where they arrive.
    """

    def __init__(self, words: bytes, stream: np.ndarray, names: list[list[str]], nameless: np.ndarray, window: int):
        self.words, self.stream, self.names, self.nameless, self.window = words, stream, names, nameless, window
        self.vocabulary = {w: k for k, w in enumerate(words.split())}
        s = np.concatenate([stream, np.full(window + 1, -1, dtype=stream.dtype)])
        walls = np.flatnonzero(stream < 0)
        #: Of each text its place in the stream and its end.
        self.begins, self.stops = np.r_[0, walls[:-1] + 1].astype(np.int64)[: len(walls)], walls
        size = self.stops - self.begins
        count = np.maximum(size - window, 0) + 1
        owner = np.repeat(np.arange(len(size)), count)
        at = self.begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(window, size)[owner]
        # windows in order of their words, of which there are no more than the length says
        column = lambda k: np.where(k < length, s[np.minimum(at + k, len(s) - 1)], -1).astype(np.int64) + 1
        keys = [(column(k) << 32) | (column(k + 1) if k + 1 < window else 0) for k in range(0, window, 2)]
        order = np.lexsort((at, *keys[::-1]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0) if keys else False
        #: Of one occurrence of each distinct window its place and words; where its texts begin in the list of texts.
        self.starts, self.lengths = at[order[new]], length[order[new]]
        self.first = np.r_[np.flatnonzero(new), len(order)]
        self.texts = owner[order].astype(np.int32)
        self.ids = s
        self.pairs = np.unique(s[self.starts].astype(np.int64) * (len(self.vocabulary) + 1) + s[self.starts + 1] + 1)
        self.singles = np.unique(s[self.starts[self.lengths == 1]])

    def __reduce__(self) -> tuple:
        return Benchmark, (self.words, self.stream, self.names, self.nameless, self.window)

    def texts_of(self, window: int) -> np.ndarray:
        """The texts that have a window."""
        return np.unique(self.texts[self.first[window] : self.first[window + 1]])

    @classmethod
    def build(cls, rows: list[tuple[str | None, bytes]], window: int) -> Benchmark:
        vocabulary: dict[bytes, int] = {}
        owners: dict[bytes, set[str | None]] = {}
        for name, text in rows:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], dtype=np.int32)
            if len(ids):
                owners.setdefault(ids.tobytes(), set()).add(name)
        wall = np.array([-1], dtype=np.int32)
        stream = np.concatenate([x for ids in owners for x in (np.frombuffer(ids, dtype=np.int32), wall)] or [wall[:0]])
        names = [sorted(n for n in o if n is not None) for o in owners.values()]
        return cls(b" ".join(vocabulary), stream, names, np.array([None in o for o in owners.values()], dtype=bool), window)


def suffix_array(ids: np.ndarray, bench: Benchmark, window: int) -> np.ndarray:
    """Starts of the suffixes that can match, ordered by their first words; ids ends in window walls."""
    n = len(ids) - window
    inside = ids[:n] >= 0
    can = np.isin(ids[:n] * (len(bench.vocabulary) + 1) + ids[1 : n + 1] + 1, bench.pairs) | np.isin(ids[:n], bench.singles)
    at = np.flatnonzero(inside & can)
    keys = [((ids[at + k] + 1) << 32) | (ids[at + k + 1] + 1 if k + 1 < window else 0) for k in range(0, window, 2)]
    return at[np.lexsort(keys[::-1])]


def bisect(ids: np.ndarray, sa: np.ndarray, depth: int, want: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """For each wanted word, the first place in low..high of the suffix array whose word at this depth is not less, or is greater."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        has = ids[sa[np.minimum(mid, len(sa) - 1)] + depth]
        right = open_ & ((has <= want) if after else (has < want))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


def search(ids: np.ndarray, sa: np.ndarray, bench: Benchmark, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of the suffix array that each benchmark suffix's window occupies, by binary search."""
    low = np.zeros(len(bench.starts), dtype=np.int64)
    high = np.full(len(bench.starts), len(sa), dtype=np.int64)
    for depth in range(window):
        live = np.flatnonzero((high > low) & (bench.lengths > depth))
        want = bench.ids[bench.starts[live] + depth]
        first = bisect(ids, sa, depth, want, low[live], high[live], False)
        high[live] = bisect(ids, sa, depth, want, first, high[live], True)
        low[live] = first
    return low, high


def matches(ids: np.ndarray, bench: Benchmark, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and window of every occurrence in ids; at a place stands one window of each length at most."""
    sa = suffix_array(ids, bench, window)
    low, high = search(ids, sa, bench, window)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return sa[low[which] + within], which


def longest_matches(parts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of each part its longest verbatim match with an item: words, place in the part, item, place in the item.

    All are ordered in one suffix array by doubling. A suffix of a part shares most with the nearest
    item suffix on one of its sides; how much, the ranks kept from each doubling tell.
    """
    sizes = np.array([len(x) for x in [*parts, *items]])
    begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
    top = max(int(x.max()) for x in [*parts, *items]) + 1
    t = np.empty(sizes.sum() + len(sizes), dtype=np.int64)
    for k, (at, x) in enumerate(zip(begin.tolist(), [*parts, *items], strict=True)):
        t[at : at + len(x)] = x
        t[at + len(x)] = top + k
    n = len(t)
    ranks, known = [np.unique(t, return_inverse=True)[1].astype(np.int32)], 1
    order = np.argsort(ranks[0], kind="stable")
    while known < max(len(x) for x in parts):
        after = np.zeros(n, dtype=np.int64)
        after[: n - known] = ranks[-1][known:].astype(np.int64) + 1
        key = ranks[-1].astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        ranks.append(rank)
        known *= 2
    item_from = begin[len(parts)]
    place = np.arange(n)
    is_item = order >= item_from
    back = np.maximum.accumulate(np.where(is_item, place, -1))
    ahead = np.minimum.accumulate(np.where(is_item, place, n)[::-1])[::-1]
    mine = np.flatnonzero(~is_item)
    best, other = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for side in (back[mine], ahead[mine]):
        has = (side >= 0) & (side < n)
        a, b = order[mine[has]], order[side[has]]
        shared = np.zeros(len(a), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = a + shared, b + shared
            inside = (x < n) & (y < n)
            same = np.zeros(len(a), dtype=bool)
            same[inside] = ranks[k][x[inside]] == ranks[k][y[inside]]
            shared += same * (1 << k)
        better = shared > best[a]
        best[a[better]], other[a[better]] = shared[better], b[better]
    where = np.array([at + int(best[at : at + len(x)].argmax()) for at, x in zip(begin.tolist(), parts, strict=False)], dtype=np.int64)
    item = np.searchsorted(begin, other[where], side="right") - 1
    return best[where], where - begin[: len(parts)], item - len(parts), other[where] - begin[item]


MATCH = "struct<words:long,start:long,item:string,item_start:long>"
FOUND = f"n_words long, spans array<struct<start:long,end:long>>, items array<string>, nameless boolean, longest {MATCH}"


def shard_hits(column: pa.Array, bench: Benchmark, window: int) -> Iterator[tuple]:
    """Of each text of a shard: its number of words, its runs of hit words, the items found in it, whether one has no id, the longest match."""
    get = bench.vocabulary.get
    parts = []
    for text in byte_views(column):
        w = words_of(bytes(text))
        parts.append(np.fromiter((get(x, -1) for x in w), dtype=np.int64, count=len(w)))
    begin = np.cumsum([0, *(len(x) + 1 for x in parts)])
    ids = np.full(begin[-1] + window + 1, -1, dtype=np.int64)
    for k, x in zip(begin, parts, strict=False):
        ids[k : k + len(x)] = x
    start, which = matches(ids, bench, window) if len(bench.starts) else (np.empty(0, dtype=np.int64),) * 2
    depth = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + bench.lengths[which], -1)
    runs = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(depth) > 0).astype(np.int8), 0])).reshape(-1, 2)
    owner, met = np.searchsorted(begin, runs[:, 0], side="right") - 1, np.searchsorted(begin, start, side="right") - 1
    pairs = np.unique(met * (len(bench.starts) + 1) + which)
    met, which = pairs // (len(bench.starts) + 1), pairs % (len(bench.starts) + 1)
    best: list[tuple] = []
    if len(runs):
        used = np.unique(np.concatenate([bench.texts_of(k) for k in np.unique(which).tolist()]))
        best = list(zip(*(x.tolist() for x in longest_matches([ids[a:b] for a, b in runs.tolist()], [bench.stream[bench.begins[k] : bench.stops[k]] for k in used.tolist()])), strict=True))
    at, run = 0, 0
    for k, x in enumerate(parts):
        spans, texts, longest = [], [], None
        while run < len(runs) and owner[run] == k:
            words, place, item, item_start = best[run]
            spans.append({"start": int(runs[run, 0] - begin[k]), "end": int(runs[run, 1] - begin[k])})
            if longest is None or words > longest["words"]:
                longest = {"words": words, "start": spans[-1]["start"] + place, "item": next(iter(bench.names[used[item]]), None), "item_start": item_start}
            run += 1
        while at < len(met) and met[at] == k:
            texts.append(bench.texts_of(which[at]))
            at += 1
        texts = np.unique(np.concatenate(texts)) if texts else ()
        yield len(x), spans, sorted({n for i in texts for n in bench.names[i]}), any(bench.nameless[i] for i in texts), longest


def block_hits(rows: DataFrame, bench, window: int, all_rows: bool) -> DataFrame:
    """The columns of rows but text, and FOUND, of each row or of those with a hit, for one block."""
    keep = [c for c in rows.columns if c != "text"]
    kinds = [f.dataType.simpleString() for f in rows.select(*keep).schema]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        match = pa.struct([("words", pa.int64()), ("start", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())])
        types = [pa.int64(), pa.list_(run), pa.list_(pa.string()), pa.bool_(), match]
        for batch in batches:
            held, places, names = [], [], 0

            def packed(batch=batch) -> pa.RecordBatch:
                found = list(zip(*held, strict=True)) or [()] * len(types)
                own = batch.select(keep).take(pa.array(places, pa.int64()))
                return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(found, types, strict=True))], [*keep, "n_words", "spans", "items", "nameless", "longest"])

            for k, hit in enumerate(shard_hits(batch.column("text"), bench.value, window)):
                if all_rows or hit[1]:
                    held.append(hit)
                    places.append(k)
                    names += len(hit[2])
                if names > NAMES:
                    yield packed()
                    held, places, names = [], [], 0
            yield packed()

    return rows.mapInArrow(each, ", ".join(f"{c} {k}" for c, k in zip(keep, kinds, strict=True)) + f", {FOUND}")


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int, nameless: bool) -> tuple[int, Iterator]:
    """The number of blocks and, one by one, the benchmark in broadcasts of about block_bytes of distinct text."""
    spark = prepare(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text")).dropna(subset=["text"] if nameless else ["name", "text"]).distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // block_bytes))

    def each() -> Iterator:
        for k in range(blocks):
            held = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()
            yield spark.sparkContext.broadcast(Benchmark.build([(r["name"], r["text"].encode()) for r in held], window))

    return blocks, each()


def plain(docs: DataFrame, *key: Column) -> DataFrame:
    return docs.select(*key, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, nameless: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted), longest, contaminated.

    A document word is hit if it lies in an occurrence of a window of an item: window consecutive
    words, or the whole item if it has fewer. longest is the longest verbatim match: its words, where
    it starts in the document, an item that has it (the first by name) and where it starts there;
    null without one. Null texts have no words: such documents are clean, such items match nothing.
    Items without an id match nothing either, or with nameless count as one item that has no name in
    items. Repeated items count once by id. With an empty benchmark every document is clean. An item is never
    cut, so one of more than block_bytes makes a block of its own size. With
    several blocks rows are told apart by file and place in the file, as ids may be null or repeated.
    Other columns of either table are ignored, whatever their names.
    """
    blocks, each = benchmark_blocks(benchmark, window, block_bytes, nameless)
    if blocks == 1:
        met = block_hits(plain(docs), next(each), window, True)
    else:
        docs = stored(docs, "docs")
        rows, found = plain(docs, *row_key(docs)), []
        for k, bench in enumerate(each):
            found.append(materialize(block_hits(rows, bench, window, k == 0), "hits"))
            bench.destroy()
        met = reduce(DataFrame.unionByName, found).groupBy("file", "pos").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.bool_or("nameless").alias("nameless"), F.max_by("longest", F.struct(F.coalesce("longest.words", F.lit(0)), -F.coalesce("longest.start", F.lit(0)))).alias("longest"))
    zero = F.lit(0).cast("long")
    merged = F.aggregate(
        F.array_sort("spans"), F.struct(zero.alias("n"), zero.alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(zero, s["end"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")))
    return met.withColumn("m", merged["n"]).select(
        "doc_id", "n_words", F.col("m").alias("n_hit"), (F.size("items") + F.col("nameless").cast("int")).cast("long").alias("n_items"), F.array_sort("items").alias("items"),
        "longest", (F.col("m") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, nameless: bool = False) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs; all columns and other rows stay.

    Null and empty texts stay, and so do all rows if the benchmark is empty. With nameless, items
    without an id count too. Columns of any name pass through. Empty in, empty out.
    """
    blocks, each = benchmark_blocks(benchmark, window, block_bytes, nameless)
    if blocks == 1:
        bench, at = next(each), docs.columns.index("text")

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not hit[1] for hit in shard_hits(b.column(at), bench.value, window)], pa.bool_()))

        return docs.mapInArrow(clean, docs.schema)
    docs = stored(docs, "docs")
    file, pos = fresh(docs, 2)
    rows, found = plain(docs, *row_key(docs)), []
    for bench in each:
        found.append(materialize(block_hits(rows, bench, window, False).select(F.col("file").alias(file), F.col("pos").alias(pos)), "hits"))
        bench.destroy()
    key = row_key(docs)
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns), key[0].alias(file), key[1].alias(pos))
    return own.join(reduce(DataFrame.unionByName, found), [file, pos], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    match = lambda field, none: F.coalesce(f"longest.{field}", F.lit(none).cast("long")).alias(f"longest_{field}")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", match("words", 0), match("start", -1))


OP10_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM bi),
ks AS (SELECT DISTINCT k FROM bwin),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
m AS (SELECT d.doc_id, d.i, d.k, d.win, b.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM di) d JOIN bwin b ON d.k = b.k AND d.win = b.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
pos AS (SELECT row_number() OVER () AS r, w FROM bw WHERE len(w) > 0),
bp AS (SELECT r, k, j, array_to_string(w[j:j + k - 1], ' ') AS win FROM (SELECT r, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM pos)),
diag AS (SELECT DISTINCT m.doc_id, m.k, r, m.i, m.i - j AS d FROM (SELECT DISTINCT doc_id, i, k, win FROM m) AS m JOIN bp ON bp.k = m.k AND bp.win = m.win),
isle AS (SELECT doc_id, k, i, i - row_number() OVER (PARTITION BY doc_id, k, r, d ORDER BY i) AS g, r, d FROM diag),
runs AS (SELECT doc_id, min(i) - 1 AS start, count(*) + k - 1 AS n FROM isle GROUP BY doc_id, k, r, d, g),
longest AS (SELECT doc_id, max(n)::BIGINT AS words, arg_max(start, {'n': n, 's': -start})::BIGINT AS start FROM runs GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.names, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated,
       coalesce(longest.words, 0) AS longest_words, coalesce(longest.start, -1) AS longest_start
FROM dw LEFT JOIN longest ON dw.doc_id = longest.doc_id LEFT JOIN hits ON dw.doc_id = hits.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
