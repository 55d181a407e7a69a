"""The registered queries against their SQL, and the pipeline's stages one by one."""

import collections
import hashlib
import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_operators import brute_hits, stays_right

import corpus_pipeline
from fathomtext.llm import toxicity
from fathomtext.llm.queries import QUERIES, SQL
from fathomtext.llm.shared import materialize, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "sales", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    # whole numbers beside nulls come as floats from one engine
    plain = lambda df: sorted(str(["-" if pd.isna(x) else str(x).removesuffix(".0") for x in r]) for r in df[cols].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["op3_html_text", "op4_token_counts", "op9_pii"])
def test_whole_tables(spark, name):
    source = "pages" if name.startswith("op3") else "documents"
    assert QUERIES[name](spark, SF).count() == table(spark, SF, source).count()


def test_stages(spark):
    docs = table(spark, SF, "documents")
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), name)
        if name != "byte_bpe":
            assert after.columns == docs.columns
            assert after.join(docs, ["doc_id", "text"], "left_anti").count() == 0
        docs = after
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[-1] == left[-2] > 0.5 * left[0]
    assert corpus_pipeline.run(spark, SF).count() == left[-1]


def brute_stages(spark, sf, docs):
    """What each stage must leave of the rows (dicts) before it, stage by stage; the actual rows go on to the next."""
    import public_tokenizers
    import tiktoken

    from fathomtext.llm.byte_bpe import public_table

    def toxic(rows):
        frame = table(spark, sf, "documents")
        chain = toxicity.learn(frame, table(spark, sf, "labels"), toxicity.CHAIN)
        return [r for r, p in zip(rows, toxicity.Scorer(chain)([r["text"] for r in rows])[:, -1], strict=True) if p <= chain.threshold]

    def exact(rows):
        best = {}
        for r in rows:
            held = best.get(r["text"] or "")
            if held is None or (r["doc_id"] is not None and (held["doc_id"] is None or r["doc_id"] > held["doc_id"])):
                best[r["text"] or ""] = r
        return list(best.values())

    def clean(rows):
        items = [(r["item_id"] if r["item_id"] is not None else "none", r["text"]) for r in table(spark, sf, "benchmark").collect()]
        return [r for r in rows if not brute_hits(r["text"], items)[4]]

    def tokens(rows):
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: r for b, r in ranks(public_table()[0])}, special_tokens={})
        out = []
        for r in rows:
            ids = np.array(own.encode_ordinary(r["text"] or ""), dtype="<u4").tobytes()
            out.append({"doc_id": r["doc_id"], "n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256((r["text"] or "").encode()).hexdigest()})
        return out

    return {"toxicity": toxic, "exact_dedup": exact, "near_dedup": None, "decontamination": clean, "byte_bpe": tokens}


def ranks(path):
    import base64

    with open(path, "rb") as f:
        for line in f:
            a, b = line.split()
            yield base64.b64decode(a), int(b)


def bag(rows):
    return collections.Counter(tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows)


def holds_stage_by_stage(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute_stages(spark, sf, docs)
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = materialize(stage(spark, docs, sf), name)
        after = [r.asDict() for r in docs.collect()]
        if want[name]:
            of = (lambda rows: bag(rows)) if name == "byte_bpe" else (lambda rows: bag([{c: r[c] for c in ("doc_id", "text")} for r in rows]))
            assert of(after) == of(want[name](before)), name
        else:
            named = {r["doc_id"]: r["text"] or "" for r in before if r["doc_id"] is not None}
            kept = {r["doc_id"] for r in after if r["doc_id"] is not None}
            assert stays_right(list(named.items()), kept) and sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)
    return after


def test_stages_against_brute_force(spark):
    assert len(holds_stage_by_stage(spark, SF)) > 50


def test_stages_on_odd_rows(spark, tmp_path):
    con = duckdb.connect()
    docs = con.sql(f"SELECT * FROM read_parquet('{SF}/documents.parquet') WHERE n_chars < 3000").arrow()
    docs = docs.read_all() if hasattr(docs, "read_all") else docs
    odd = [(None, None), (None, "some words"), (9001, None), (9002, ""), (9003, "x " * 30_000), (9004, "tie"), (9005, "tie"), (9005, "tie"), (9006, "no item")]
    more = pa.table({"doc_id": pa.array([i for i, _ in odd], pa.int64()), "text": pa.array([t for _, t in odd], pa.string())})
    both = pa.concat_tables([docs, more], promote_options="default")
    for c in ("__id", "key", "fp", "file"):
        both = both.append_column(c, pa.array([f"{c}{i}" for i in range(len(both))]))
    pq.write_table(both, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, None, 3, None], pa.int64()), "text": ["no such thing at all", None, "", "no item"]}), tmp_path / "benchmark.parquet")
    con.execute(f"COPY (SELECT * FROM read_parquet('{SF}/labels.parquet') UNION ALL SELECT NULL, 1, NULL) TO '{tmp_path}/labels.parquet'")
    left = {r["doc_id"] for r in holds_stage_by_stage(spark, f"file://{tmp_path}")}
    assert 9006 not in left and 9004 not in left and 9005 in left
