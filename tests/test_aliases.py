"""Aliases replaced in one pass, as if one after the other."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fathomtext.functions import text as X
from fathomtext.plans import vocabulary as V


def one_by_one(text, aliases):
    for a, c in aliases.items():
        text = text.replace(f"[[{a}]]", f"[[{c}]]")
    return text


@pytest.mark.parametrize("aliases", [V.ALIASES, {"a": "b", "b": "c", "d": "a", "c": "c", "e": "f", "f": "e"}, {}, {"x": "x"}, {"é中": "$1\\", "a.b": "a|b"}])
def test_one_pass_equals_one_by_one(spark, aliases):
    rng = random.Random(1)
    names = [*aliases, *aliases.values(), "other", "a.b", "axb", "[", "]"]
    piece = lambda: rng.choice(["[[", "]]", "[", "]", " ", "x\n", "é", *(f"[[{rng.choice(names)}]]" for _ in range(6))])
    texts = ["", "[[", "[[]]", "[[[a]]]", *("".join(piece() for _ in range(rng.randrange(25))) for _ in range(300))]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r["t"]: r["x"] for r in frame.select("t", X.rename_links(F.col("t"), aliases).alias("x")).collect()}
    assert got == {t: one_by_one(t, aliases) for t in texts} | {None: None}


def test_names_with_brackets_are_refused():
    with pytest.raises(ValueError, match="brackets"):
        X.rename_links(F.lit("x"), {"a]": "b"})


def test_time_does_not_depend_on_the_number_of_aliases(spark):
    text = " ".join(f"word [[n{i}]] [[alias{i % 50}]]" for i in range(200))
    frame = spark.range(4000).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t")).repartition(4)
    frame = spark.createDataFrame(frame.toPandas())
    took = {}
    for n in (50, 1600):
        query = frame.select(F.sum(F.length(X.rename_links(F.col("t"), {f"alias{i}": f"name{i}" for i in range(n)}))).alias("n"))
        query.collect()
        began = time.perf_counter()
        total = query.first()["n"]
        took[n] = time.perf_counter() - began
        assert total == 4000 * (len(text) - 200) + sum(len(str(i)) for i in range(4000))
    assert took[1600] < 4 * took[50] + 0.5
