"""Toxicity by a classifier chain.

The categories are label columns, in the order of the chain. Each has a linear model over features
of words; from the second on, a model also sees the probabilities of all categories before it. It is
trained with out-of-fold predictions of those, so that in training they are as uncertain as they
will be on new texts. A feature is a word or its first four or five characters, as a share of the
document's words, so a document's score is the mean of its words' weights. Features are hashed for
training; only those that tell the classes apart beyond chance get a weight, and the model holds
these by name. Copies and near copies in the sample count once, else the words of a text that is
copied often would look telling.

Training takes at most ``sample`` labelled rows of each class of the last category, in the order of
a hash of the id; everything else covers all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, prepare, table, texts

#: Labelled rows of each class that are fitted on at most, and folds.
SAMPLE, FOLDS = 1500, 5
#: Hash range of the features; documents that a feature must occur in; scale of shares.
DIM, MIN_DOCS, SCALE = 1 << 20, 5, 50.0
#: Odd multipliers of the hashes by which near copies in the sample are found.
MIXERS = tuple((0x9E3779B1 * k * k + 2 * k) | 1 for k in range(1, 9))
#: The chain over ``labels``: a junk category from quality, then toxicity.
CHAIN = {"low_quality": lambda: 1 - F.col("quality"), "toxic": lambda: F.col("toxic")}
#: Log-likelihood ratio by which a feature's shares must differ between the classes: about 1e-5 by chance.
CHANCE = 20.0
#: Words without weight that every text is taken to have besides: one word in a short text is weak evidence.
PRIOR_WORDS = 100
PREFIXES, EDGE = (4, 5), ".,;:!?\"'()[]{}*#$%&|-_<>/"


def word_features(word: str) -> list[str]:
    """A lower-case word itself and its first four and five characters, without punctuation around it."""
    w = word.strip(EDGE)
    return [f"{n}{w[:n or None]}" for n in (0, *PREFIXES) if len(w) >= max(1, n)]


def features(text: str) -> tuple[list[str], list[float]]:
    """The features of a whole text and the share of its words that has each."""
    words, total = Counter(text.lower().split()), Counter()
    for w, c in words.items():
        for f in word_features(w):
            total[f] += c
    n = words.total() + PRIOR_WORDS
    return list(total), [c / n for c in total.values()]


@dataclass
class Sparse:
    """Rows of (column, value) on end."""

    starts: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    def take(self, rows: np.ndarray) -> Sparse:
        size = (self.starts[1:] - self.starts[:-1])[rows]
        at = np.repeat(self.starts[:-1][rows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return Sparse(np.r_[0, np.cumsum(size)], self.cols[at], self.vals[at])

    def dot(self, w: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return np.bincount(rows, weights=self.vals * w[self.cols], minlength=len(self.starts) - 1)

    def back(self, g: np.ndarray, dim: int) -> np.ndarray:
        return np.bincount(self.cols, weights=self.vals * np.repeat(g, np.diff(self.starts)), minlength=dim)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def telling(x: Sparse, y: np.ndarray) -> tuple[Sparse, np.ndarray]:
    """x with only the features whose share of documents differs between the classes beyond chance, scaled, and their numbers."""
    rows = np.repeat(np.arange(len(y)), np.diff(x.starts))
    a, b = (np.bincount(x.cols[y[rows] == k], minlength=DIM) for k in (1, 0))
    na, nb = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    g = np.zeros(DIM)
    for k, n in ((a, na), (b, nb)):
        for seen, both in ((k, a + b), (n - k, na + nb - a - b)):
            g += 2 * seen * np.log(np.maximum(seen, 1e-9) * (na + nb) / np.maximum(both * n, 1e-9))
    used = np.flatnonzero((g >= CHANCE) & (a + b > 0))
    keep = np.isin(x.cols, used)
    starts = np.r_[0, np.cumsum(np.bincount(rows[keep], minlength=len(y)))]
    return Sparse(starts, np.searchsorted(used, x.cols[keep]), x.vals[keep] * SCALE), used


def fit(x: Sparse, before: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with balanced classes, by Adam on all rows: word weights, weights of earlier categories, intercept."""
    w, v, b = np.zeros(DIM), np.zeros(before.shape[1]), 0.0
    if len(np.unique(y)) < 2:
        return w, v, float(logit(np.array(y.mean() if len(y) else 0.0)))
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    small, used = telling(x, y)
    n = len(used)
    theta, m, s = np.zeros(n + len(v) + 1), np.zeros(n + len(v) + 1), np.zeros(n + len(v) + 1)
    for t in range(1, rounds + 1):
        z = small.dot(theta[:n]) + before @ theta[n:-1] + theta[-1]
        g = (sigmoid(z) - y) * share
        grad = np.r_[small.back(g, n) + penalty * theta[:n], before.T @ g, g.sum()]
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    w[used] = theta[:n] * SCALE
    return w, theta[n:-1], float(theta[-1])


@dataclass
class Chain:
    """Models of all categories in the order of the chain, and the threshold of the last."""

    names: list[str]
    weights: dict[str, tuple[float, ...]]
    links: list[np.ndarray]
    intercepts: list[float]
    threshold: float

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """Of documents' mean word weights (rows x categories), each category's probability."""
        out = np.zeros_like(scores)
        for k in range(len(self.names)):
            out[:, k] = sigmoid(scores[:, k] + logit(out[:, :k]) @ self.links[k] + self.intercepts[k])
        return out


def once(lows: np.ndarray) -> np.ndarray:
    """Rows of which none is a near copy of one before: none shares two smallest hashes of its rare features with it. lows: rows x MIXERS, -1 without rare features."""
    seen: set[tuple[int, int, int]] = set()
    keep = []
    for i, row in enumerate(lows.tolist()):
        bands = {(k, row[2 * k], row[2 * k + 1]) for k in range(len(row) // 2)} if row[0] >= 0 else set()
        if not bands & seen:
            keep.append(i)
        seen |= bands
    return np.array(keep, dtype=np.int64)


def train(x: Sparse, labels: np.ndarray, names: list[str], spelled: dict[int, set[str]] | Callable[[np.ndarray], dict[int, set[str]]], folds: int = FOLDS) -> Chain:
    """labels: rows x categories, in the order of the chain. Each later model sees out-of-fold logits of the earlier. spelled: the features of each hash, or what gives them for those that get a weight."""
    n = len(labels)
    fold = np.arange(n) % folds
    outside = np.zeros((n, len(names)))
    weights, links, intercepts = [], [], []
    for k in range(len(names)):
        y, before = labels[:, k].astype(float), logit(outside[:, :k])
        for f in range(folds):
            inn, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(inn) and len(out):
                w, v, b = fit(x.take(inn), before[inn], y[inn])
                outside[out, k] = sigmoid(x.take(out).dot(w) + before[out] @ v + b)
        w, v, b = fit(x, before, y)
        weights.append(w)
        links.append(v)
        intercepts.append(b)
    table = np.stack(weights, axis=1)
    used = np.flatnonzero(table.any(axis=1))
    spelled = spelled(used) if callable(spelled) else spelled
    named = {f: tuple(table[k].tolist()) for k in used.tolist() for f in spelled.get(k, ())}
    return Chain(names, named, links, intercepts, best_threshold(outside[:, -1], labels[:, -1]) if n else 0.5)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the range of thresholds with the best F1 on out-of-fold predictions, of those that are right at least every second time.

    Without such a threshold nothing is over it: a model that tells nothing rejects nothing. 0.5 with one class.
    """
    if len(np.unique(y)) < 2:
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    taken = np.arange(1, len(p) + 1)
    f1 = np.where(2 * hit >= taken, 2 * hit / (taken + y.sum()), 0.0)
    ranked = p[order]
    if not f1.any() or ranked[0] == ranked[-1]:
        return 1.0
    k = int(f1.argmax())
    return float((ranked[k] + (ranked[k + 1] if k + 1 < len(p) else 0)) / 2)


def telling_somewhere(posts: DataFrame, names: list[str], labels: np.ndarray, folds: int = FOLDS) -> DataFrame:
    """col of the features that may get a weight: common enough, and telling for a category on all rows or on those outside a fold.

    posts: col, fold and the categories, a row for each feature of a labelled text. The counts are the
    ones that telling() takes, so a fit on any of these sets of rows misses none of its features.
    """
    fold = np.arange(len(labels)) % folds
    seen = posts.groupBy("col").agg(F.count(F.lit(1)).alias("n"), *(F.count_if((F.col(k) == v) & (F.col("fold") == f)).alias(f"{i}_{v}_{f}") for i, k in enumerate(names) for v in (0, 1) for f in range(folds)))
    tells = F.lit(False)
    for i in range(len(names)):
        for out in range(-1, folds):
            at = [f for f in range(folds) if f != out]
            a, b = (reduce(add, (F.col(f"{i}_{v}_{f}") for f in at)).cast("double") for v in (1, 0))
            na, nb = (float(max(1, ((labels[:, i] == v) & (fold != out)).sum())) for v in (1, 0))
            g = F.lit(0.0)
            for k, n in ((a, na), (b, nb)):
                for own, both in ((k, a + b), (n - k, na + nb - a - b)):
                    g += 2 * own * F.log(F.greatest(own, F.lit(1e-9)) * (na + nb) / F.greatest(both * n, F.lit(1e-9)))
            tells |= g >= CHANCE - 1e-6
    return seen.where((F.col("n") >= min(MIN_DOCS, max(1, len(labels) // 20))) & tells).select("col")


def learn(docs: DataFrame, labels: DataFrame, chain: dict[str, Column], sample: int = SAMPLE) -> Chain:
    """Fit on at most sample labelled documents of each class of the chain's last category.

    Labels with a null id or a null category are left out; of repeated labels of an id the largest
    counts, and of several texts with an id one. All features of a text count, however long it is: they stay
    on the executors, which find near copies and choose what can get a weight, and only that goes to
    the driver. Without labels, or with one class, probabilities are that class's share.
    """
    names = list(chain)
    marked = labels.select(F.col("doc_id").alias("id"), *(chain[k]().cast("int").alias(k) for k in names)).dropna()
    marked = marked.groupBy("id").agg(*(F.max(k).alias(k) for k in names))
    picked = [marked.where(F.col(names[-1]) == v).orderBy(F.xxhash64("id"), "id").limit(sample) for v in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample rows at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t) for t in b.column("text").to_pylist()]
            cols = pa.array([[zlib.crc32(f.encode()) % DIM for f in own] for own, _ in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(k) for k in names), cols, pa.array([v for _, v in made], pa.list_(pa.float32())), pa.array([f for f, _ in made], pa.list_(pa.string()))], ["id", *names, "cols", "vals", "spelled"])

    kinds = "id long, " + "".join(f"{k} int, " for k in names) + "cols array<long>, vals array<float>, spelled array<string>"
    met = texts(docs).join(picked, F.col("doc_id") == F.col("id")).select("id", *names, "text")
    met = met.groupBy("id").agg(F.min(F.struct(*names, "text")).alias("row")).select("id", "row.*")
    met = materialize(met.mapInArrow(each, kinds), "features")
    posts = met.select("id", *names, F.explode(F.arrays_zip("cols", "vals")).alias("x")).select("id", *names, F.col("x.cols").alias("col"), F.col("x.vals").alias("val"))
    posts = materialize(posts.groupBy("id", *names, "col").agg(F.sum("val").alias("val")), "posts")
    rare = posts.groupBy("col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max(2, met.count() // 20))
    low = [F.min((F.col("col") * m + (m >> 7)).bitwiseAND(F.lit(0xFFFFFFFF))) for m in MIXERS]
    lows = posts.join(rare, "col").groupBy("id").agg(F.array(*low).alias("lows"))
    # a row of a few numbers for each labelled text
    rows = met.select("id", *names, F.xxhash64("spelled", "vals").alias("same")).join(lows, "id", "left").collect()
    rows = list({r["same"]: r for r in sorted(rows, key=lambda r: -r["id"])}.values())
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    rows = [rows[i] for i in once(np.array([r["lows"] or [-1] * len(MIXERS) for r in rows], dtype=np.int64).reshape(len(rows), len(MIXERS)))]
    y = np.array([[r[k] for k in names] for r in rows], dtype=np.int64).reshape(len(rows), len(names))
    kept = docs.sparkSession.createDataFrame([(r["id"], i % FOLDS) for i, r in enumerate(rows)], "id long, fold int")
    own = posts.join(F.broadcast(kept), "id")
    chosen = materialize(telling_somewhere(own, names, y), "chosen")
    found = {r["id"]: r for r in own.join(chosen, "col").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("x")).select("id", "x.col", "x.val").toArrow().to_pylist()}

    def spelled(wanted: np.ndarray) -> dict[int, set[str]]:
        """The names of the features that got a weight."""
        used = docs.sparkSession.createDataFrame([(int(k),) for k in wanted], "cols long")
        pairs = met.select(F.explode(F.arrays_zip("cols", "spelled")).alias("x")).select("x.*").join(F.broadcast(used), "cols").distinct()
        held: dict[int, set[str]] = {}
        for r in pairs.collect():
            held.setdefault(r["cols"], set()).add(r["spelled"])
        return held

    parts = [found.get(r["id"], {"col": [], "val": []}) for r in rows]
    x = Sparse(np.cumsum([0, *(len(p["col"]) for p in parts)]), np.concatenate([*(np.array(p["col"], dtype=np.int64) for p in parts), np.empty(0, np.int64)]), np.concatenate([*(np.array(p["val"], dtype=np.float64) for p in parts), np.empty(0)]))
    return train(x, y, names, spelled)


class Scorer:
    """Mean word weights of texts."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.by_size = [{f[1:]: w for f, w in chain.weights.items() if f[0] == str(n)} for n in (0, *PREFIXES)]

    def scores(self, text: str) -> list[float]:
        words = Counter(text.lower().split())
        n, total = words.total() + PRIOR_WORDS, [0.0] * len(self.chain.names)
        whole, short, long = (d.get for d in self.by_size)
        a, b = PREFIXES
        for w, c in words.items():
            w = w.strip(EDGE)
            for got in (whole(w), short(w[:a]), long(w[:b])):
                if got is not None:
                    for k, x in enumerate(got):
                        total[k] += c * x
        return [x / n for x in total]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return self.chain.probabilities(np.array([self.scores(t or "") for t in texts]).reshape(len(texts), len(self.chain.names)))


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per document: doc_id, one probability per category, toxic (the last is over the threshold).

    Null and empty texts have no words and get the models' intercepts. Rows stay as they are,
    repeated ones and ones without an id too; other columns are ignored. Empty in, empty out.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value)
        for b in batches:
            p = score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] > held.value.threshold)], ["doc_id", *(f"p_{k}" for k in chain.names), "rejected"])

    return texts(docs).mapInArrow(each, "doc_id long, " + "".join(f"p_{k} double, " for k in chain.names) + "rejected boolean")


def drop_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs without the rows that the chain rejects; all columns and other rows stay."""
    prepare(docs.sparkSession)
    held, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value)
        for b in batches:
            yield b.filter(pa.array(score(b.column(at).to_pylist())[:, -1] <= held.value.threshold))

    return docs.mapInArrow(each, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs, table(spark, sf_dir, "labels"), CHAIN)).withColumnRenamed("rejected", "toxic")
