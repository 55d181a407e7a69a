"""Line dedup with DataFrame functions only.

Lines are normalised and hashed once, in order, and stored per document as two arrays of 64-bit
hashes (together a 128-bit key). Counting takes each key once per document and sums before the
exchange. The keys over the threshold are joined back to the documents' lines, which gives each
document the places of its lines to drop; the text itself moves once, to meet them, and what is left
is put together by place, in time that grows as the lines do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, materialize, table, texts

MIN_DOCS, MIN_CHARS = 10, 1
#: So many frequent keys (16 bytes each) are sent to every executor; more are joined by a shuffle.
FEW_KEYS = 200_000
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z only. For ASCII texts that is lower(), which is far cheaper than translate()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    """The normalised lines of a text, in order."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))


def hashed(keys: Column, min_chars: int) -> Column:
    """Of each key two 64-bit hashes; null for keys that are too short to be dropped."""
    return F.transform(keys, lambda x: F.when(F.length(x) >= min_chars, F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text.

    A null or empty text is one empty line and stays. A key counts once for each row of docs, so
    repeated rows count like copies; rows are told apart by a number of their own, not by doc_id,
    which may be null or repeated. A document that loses every line has an empty kept_text. Other
    columns of docs are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = materialize(texts(docs).select("doc_id", "text", F.monotonically_increasing_id().alias("row"), hashed(line_keys(F.col("text")), min_chars).alias("keys")), "lines")
    # sorted, since array_distinct compares every two structs
    ranked = F.sort_array(F.filter("keys", lambda k: k.isNotNull()))
    once = let(ranked, lambda z: F.filter(z, lambda k, i: (i == 0) | (k != F.get(z, i - 1))))
    own = rows.select(F.explode(once).alias("key"))
    common = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("key")
    common = materialize(common, "common")
    few = F.broadcast(common) if common.count() <= FEW_KEYS else common
    places = rows.select("row", F.posexplode("keys").alias("at", "key")).where("key is not null")
    drop = places.join(few, "key").groupBy("row").agg(F.collect_list("at").alias("gone"))
    # lines is used twice, so Spark makes the array once a row and not once a line
    met = rows.select("row", "doc_id", "text", F.size("keys").alias("n")).join(drop, "row", "left").withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return met.select("doc_id", F.col("n").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d),
k AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
