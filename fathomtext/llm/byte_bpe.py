"""Byte-level BPE encoding and decoding.

Every match of the pattern is encoded on its own. A segment tree over the byte positions of the
match stores, for each position that still begins a part, the rank of the pair it makes with the
next live part; the root is the smallest rank and among equal ranks the leftmost position. A merge
takes that pair, unlinks the right part and updates the two live neighbours' leaves, so a match of
n bytes costs O(n log n) however long it is. Short matches repeat, so a worker keeps the ids of
those it saw last in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import prepare, table, texts

TABLE = "byte_bpe_multi_50k.tiktoken"
#: Matches whose ids a worker keeps, and the longest of them.
KEPT, KEPT_CHARS = 200_000, 32
NONE = (1 << 62) - 1
#: Children of a node of the segment tree: the minimum of so many is one call.
FAN = 16


def segment_tree_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match."""
    found = ranks.get(piece)
    if found is not None:
        return [found]
    n, get = len(piece), ranks.get
    shift = n.bit_length()
    mask = (1 << shift) - 1
    ends, before = list(range(1, n + 1)), list(range(-1, n))
    leaves = [NONE if (r := get(piece[i : i + 2])) is None else r << shift | i for i in range(n - 1)]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        low = levels[-1]
        levels.append([min(low[k : k + FAN]) for k in range(0, len(low), FAN)])
    top, deep = levels[-1], len(levels) > 1
    while (best := min(top, default=NONE)) != NONE:
        i = best & mask
        j = ends[i]
        end = ends[i] = ends[j]
        before[end] = i
        p = before[i]
        if end < n:
            leaves[j] = NONE
            leaves[i] = NONE if (r := get(piece[i : ends[end]])) is None else r << shift | i
        else:
            leaves[i] = NONE
        if p >= 0:
            leaves[p] = NONE if (r := get(piece[p:end])) is None else r << shift | p
        if deep:
            for at in (p, i, j):
                if at < 0:
                    continue
                for k in range(1, len(levels)):
                    at //= FAN
                    if at >= len(levels[k]):
                        break
                    value = min(levels[k - 1][at * FAN : at * FAN + FAN])
                    if levels[k][at] == value:
                        break
                    levels[k][at] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class ByteBPE:
    """Encoder and decoder of one rank file; pattern and path are parameters, nothing is copied."""

    def __init__(self, path: str, pattern: str):
        pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def packed(self, piece: str) -> bytes:
        """The ids of one match as little-endian 32-bit numbers."""
        got = self.kept.get(piece)
        if got is None:
            got = self.older.get(piece) or b"".join(x.to_bytes(4, "little") for x in segment_tree_merge(piece.encode(), self.ranks))
            if len(piece) <= KEPT_CHARS:
                if len(self.kept) >= KEPT:
                    self.older, self.kept = self.kept, {}
                self.kept[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        pieces = self.find(text)
        known = list(map(self.kept.get, pieces))
        return b"".join(self.packed(p) if x is None else x for x, p in zip(known, pieces, strict=True))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_made: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder for each worker and rank file."""
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBPE(path, pattern)
    return _made[path, pattern]


def public_table() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TABLE), public_tokenizers.PATTERN


def bpe(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, ids (little-endian 32-bit numbers), decoded, n_tokens and two digests.

    Without a path the public rank file is taken on each worker. Null texts count as empty and give
    no ids. Rows stay as they are, repeated ones and ones without an id too; other columns are
    ignored. keep_ids=False leaves the two large columns out, so they never leave the worker.
    """
    prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(*((path, pattern) if path else public_table()))
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                ids = use.encode(text)
                plain = use.decode(ids)
                rows.append((ids if keep_ids else b"", plain if keep_ids else b"", len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = texts(docs).mapInArrow(each, "doc_id long, ids binary, decoded binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out if keep_ids else out.drop("ids", "decoded")


def bpe_text(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """For a pipeline's end: doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe(docs, path, pattern, keep_ids=False)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"), keep_ids=False)
