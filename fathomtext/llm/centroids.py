"""Clustering by k-means with sorted centroids (sort-means), in exact integers.

Every round each centroid orders the others by their distance from it. A vector starts at the
centroid it was assigned to before, at distance d, and goes through the others in that order; beyond a
distance of strictly more than 2 d no centroid can be as near, by the triangle inequality, so it stops
there. Ties go to the smaller number, and as the bound is strict they are never cut off.

A round is one pass without an exchange of vectors: each task writes its vectors with their new
assignment and a row for each cluster with count, summed distance and summed components. Only these
rows are added up, and only the centroids, k times as many numbers as a vector has, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, materialize, table

CLUSTERS, ROUNDS, SEED, DIM, SCALE = 16, 3, 1, 64, 64
#: Scaled components from here on could overflow the sums of squares in 64 bits.
LARGEST = 1 << 27
ROW = "vec_id long, v array<long>, cluster int, distance long, n long, sums array<long>"


def kept(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the vectors with exactly dim components, none null or non-finite, as integers floor(scale * x)."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    usable = F.coalesce((F.size(x) == dim) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    return vectors.where(usable).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * float(scale)).cast("long")).alias("v"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest SHA-256 of seed:id, in ascending order; repeated ids by vector, rows without an id never."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.where("vec_id is not null").orderBy(key, "v").select("v").limit(clusters).collect()
    return np.array([r["v"] for r in found], dtype=np.int64)


def nearest(v: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector, ties to the smaller, and the squared distance. before: the assignments to start from."""
    squared = lambda a, b: ((a - b) ** 2).sum(axis=-1)
    between = squared(centroids[:, None], centroids[None])
    best, least = before.copy(), squared(v, centroids[before])
    for p in np.unique(before):
        own = np.flatnonzero(before == p)
        reach = 4 * least[own]  # squared: twice the distance
        for q in np.argsort(between[p], kind="stable"):
            own, reach = own[between[p, q] <= reach], reach[between[p, q] <= reach]
            if not len(own):
                break
            d = squared(v[own], centroids[q])
            nearer = (d < least[own]) | (d == least[own]) & (q < best[own])
            best[own[nearer]], least[own[nearer]] = q, d[nearer]
    return best, least


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """ROW: each vector (vec_id, v, cluster) with its new cluster and distance, and from each task a row for each of its clusters with n and sums."""
    k, dim = centroids.shape
    widest = int(np.abs(centroids).max(initial=0))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        names = ["vec_id", "v", "cluster", "distance", "n", "sums"]
        wide = pa.list_(pa.int64())
        for b in batches:
            m = b.num_rows
            v = b.column(1).flatten().to_numpy().reshape(m, dim)
            if max(widest, np.abs(v).max(initial=0)) >= LARGEST:
                raise ValueError(f"scaled components of {LARGEST} and more overflow 64-bit distances; take a smaller scale")
            best, least = nearest(v, b.column(2).to_numpy().astype(np.int64), centroids)
            n += np.bincount(best, minlength=k)
            np.add.at(inertia, best, least)
            np.add.at(sums, best, v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int32()), pa.array(least), pa.nulls(m, pa.int64()), pa.nulls(m, wide)], names)
        own = np.flatnonzero(n)
        total = pa.array(list(sums[own]), wide)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.nulls(len(own), wide), pa.array(own, pa.int32()), pa.array(inertia[own]), pa.array(n[own]), total], names)

    return rows.select("vec_id", "v", "cluster").mapInArrow(each, ROW)


def totals(rows: DataFrame, dim: int) -> dict[int, tuple[int, int, list[int]]]:
    """cluster: (vectors, inertia, summed components), from the tasks' rows."""
    part = rows.where("n is not null")
    plain = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("distance").alias("inertia"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(dim))).alias("sums"))
    return {r["cluster"]: (r["n"], r["inertia"], list(r["sums"])) for r in plain.collect()}


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, np.ndarray, dict[int, tuple[int, int, list[int]]]]:
    """(rows, centroids, totals): vec_id, cluster, distance (squared) of each kept vector, the final centroids, and per cluster (vectors, inertia, sums).

    Vectors of another length or with a null or non-finite component are left out. Repeated rows count
    as often as they occur; rows without an id are assigned but never start a centroid. With fewer
    vectors than clusters there are as many centroids as vectors with an id; with none the result is empty. A centroid
    without vectors stays where it is. Other columns, whatever their names, are ignored.
    """
    rows = materialize(kept(vectors, key, column, dim, scale).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return rows.limit(0).select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), centroids, {}
    for k in range(rounds + 1):
        done = materialize(assigned(rows, centroids), "assigned")
        forget(rows)
        found, rows = totals(done, dim), done.where("v is not null")
        rows._fathom_path = done._fathom_path
        if k < rounds:
            for c, (n, _, sums) in found.items():
                centroids[c] = [s // n for s in sums]
    return rows.select("vec_id", "cluster", "distance"), centroids, found


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids, found = cluster(table(spark, sf_dir, "embeddings"))
    digests = {c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for c in found}
    # one entry a cluster
    of = lambda values: F.create_map(*(F.lit(x) for p in values.items() for x in p))[F.col("cluster")] if values else F.lit(None)
    total = sum(x[1] for x in found.values())
    return rows.select("vec_id", "cluster", "distance", of({c: x[1] for c, x in found.items()}).cast("long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), of(digests).cast("string").alias("centroid_sha256"))


def rounds_sql() -> str:
    """A common table expression for each assignment and each new set of centroids."""
    assign = lambda k: f"""a{k} AS (
  SELECT vec_id, id, v, (d).c AS c, (d).d AS d FROM (
    SELECT vec_id, id, v, min({{'d': d, 'c': c}}) AS d FROM (
      SELECT vec_id, id, v.v, m.c, list_sum(list_transform(list_zip(v.v, m.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM v CROSS JOIN m{k} AS m)
    GROUP BY vec_id, id, v))"""  # noqa: E731
    moved = lambda k: f"""m{k + 1} AS (
  SELECT m.c, CASE WHEN any_value(a.id) IS NULL THEN any_value(m.v) ELSE any_value(s.v) END AS v FROM m{k} AS m LEFT JOIN a{k} AS a ON a.c = m.c
  LEFT JOIN (SELECT c, list(f ORDER BY i) AS v FROM (
    SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS f FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY c, i) GROUP BY c) AS s ON s.c = m.c
  GROUP BY m.c)"""  # noqa: E731
    return ",\n".join(f"{assign(k)},\n{moved(k)}" for k in range(ROUNDS)) + f",\n{assign(ROUNDS)}"


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {CLUSTERS}),
{rounds_sql()},
t AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY c)
SELECT vec_id, a.c::INTEGER AS cluster, a.d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a{ROUNDS}) AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN m{ROUNDS} AS m ON m.c = a.c JOIN t ON t.c = a.c
"""
