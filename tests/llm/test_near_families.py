"""Near dedup of texts that share a template, alike but under the similarity."""

import random

import pytest
from pyspark.sql import functions as F

from fathomtext.llm import near_dedup
from fathomtext.llm.shared import materialize


def letters(n, seed, words=400, runs=6, run=6):
    """doc_id, text: one template in which each text has runs of words of its own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    template = [word() for _ in range(words)]
    places = [words // runs * k + 5 for k in range(runs)]
    rows = []
    for i in range(n):
        text = list(template)
        for p in places:
            text[p : p + run] = [word() for _ in range(run)]
        rows.append((i, " ".join(text)))
    return rows


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture
def verified_pairs(monkeypatch):
    seen, plain = [], near_dedup.verified

    def counted(pairs, docs):
        seen.append(pairs.count())
        return plain(pairs, docs)

    monkeypatch.setattr(near_dedup, "verified", counted)
    return seen


@pytest.mark.parametrize("n", [300, 600])
def test_unlike_letters_of_one_template_do_not_all_meet(spark, verified_pairs, n):
    rows = letters(n, 5)
    sets = [set(near_dedup.shingles(t.encode()).tolist()) for _, t in rows[:20]]
    assert all(0.6 < jaccard(sets[i], sets[k]) < 0.8 for i in range(20) for k in range(i))
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "letters")
    assert near_dedup.drop_near_copies(docs).count() == n
    assert sum(verified_pairs) <= 4 * n


def test_copies_among_letters_are_found(spark, verified_pairs):
    rng, rows = random.Random(8), letters(200, 6)
    copies = []
    for i in range(0, 200, 4):
        text = rows[i][1].split()
        for _ in range(2):
            text[rng.randrange(len(text))] = f"edit{i}"
        text += [f"tail{i}x{k}" for k in range(rng.choice([0, 20, 60]))]
        copies.append((1000 + i, " ".join(text)))
    rows += copies
    sets = {i: set(near_dedup.shingles(t.encode()).tolist()) for i, t in rows}
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "letters")
    kept = {r["doc_id"] for r in near_dedup.drop_near_copies(docs).collect()}
    alike = {(i, k) for i in sets for k in sets if i != k and jaccard(sets[i], sets[k]) >= 0.8}
    assert len(alike) >= 50
    assert not any(i in kept and k in kept for i, k in alike)
    assert all(i in kept or any((i, k) in alike for k in kept) for i in sets)
    assert sum(verified_pairs) <= 4 * len(rows)


def test_rare_shingles_lose_no_pair(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefg")
    rows = []
    for g in range(40):
        base = [word() for _ in range(rng.choice([1, 4, 6, 14, 50]))]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + [word() for _ in range(rng.randrange(5))])), (len(rows) + 2, " ".join(base[1:]))]
    sets = {i: set(near_dedup.shingles(t.encode()).tolist()) for i, t in rows}
    want = {(i, k) for i in sets for k in sets if i < k and jaccard(sets[i], sets[k]) >= 0.8}
    got = {tuple(r) for r in near_dedup.prefix_pairs(spark.createDataFrame(rows, "doc_id long, text string").where(F.lit(True))).collect()}
    assert want <= got


def test_near_letters_meet_under_one_shingle(spark):
    rng, rows = random.Random(12), letters(60, 7)
    for i in range(0, 60, 2):
        for k in (1, 2):
            text = rows[i][1].split()
            text[rng.randrange(len(text))] = f"edit{i}x{k}"
            rows.append((1000 * k + i, " ".join(text)))
    sets = {i: set(near_dedup.shingles(t.encode()).tolist()) for i, t in rows}
    want = {(i, k) for i in sets for k in sets if i < k and jaccard(sets[i], sets[k]) >= 0.8}
    docs = materialize(near_dedup.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string")), "letters")
    met = [tuple(r) for r in near_dedup.meetings(docs).collect()]
    assert len(want) >= 90 and want <= set(met)
    assert len(met) == len(set(met))
