import random

from fathomtext.llm import toxicity


def test_a_word_behind_very_many_others_gets_its_weight(spark):
    """Long texts count as a whole: here the telling word comes after over 50,000 other features."""
    rng = random.Random(3)
    filler = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n))
    rows = [(i, filler(17_000 if i % 4 == 0 else 40) + (" idiot" if i % 2 == 0 else " friend")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    chain = toxicity.learn(docs, labels, toxicity.CHAIN)
    assert "0idiot" in chain.weights and chain.weights["0idiot"][1] > 0
    assert len(chain.weights) < 50  # of some 700,000 features
