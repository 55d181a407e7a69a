"""From raw documents to token digests: toxicity, exact and near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its result
is written as Parquet in the shared folder and read again. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomtext.llm.byte_bpe import bpe_text
from fathomtext.llm.decontaminate import drop_contaminated
from fathomtext.llm.exact_dedup import drop_copies
from fathomtext.llm.near_dedup import drop_near_copies
from fathomtext.llm.shared import forget, materialize, prepare, table
from fathomtext.llm.toxicity import CHAIN, drop_toxic, learn


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels, does not reject.

    Null and empty texts have no words and stay unless the labels say that most texts are toxic;
    rows without an id and repeated rows are judged by their text; without labels all rows stay.
    """
    prepare(spark)
    return drop_toxic(docs, learn(docs, table(spark, sf_dir, "labels"), CHAIN))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; nulls count as empty texts, and rows that repeat id and text as one row."""
    prepare(spark)
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, the smallest doc_id first; rows without an id stay, empty texts are copies of one another."""
    prepare(spark)
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; null and empty texts stay, null items match nothing, an empty benchmark drops nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each that is left; a null text has no tokens."""
    return bpe_text(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: Classifier, fingerprints and tokenizer have no SQL; a brute-force version stands in for it in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. An empty table gives an empty result; other columns, whatever their names, pass through all but the last stage."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_fathom_path"):
            forget(before)
        before = docs
    return docs
