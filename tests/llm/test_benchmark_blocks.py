import pickle
import random

import numpy as np

from fathomtext.llm import decontaminate
from fathomtext.llm.decontaminate import Benchmark


def random_items(rng, n, words):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    return [(str(i), " ".join(word() for _ in range(words)).encode()) for i in range(n)]


def test_what_travels_is_within_twice_the_text():
    items = random_items(random.Random(1), 200, 1000)
    size = sum(len(t) for _, t in items)
    sent = pickle.dumps(Benchmark.build(items, 10))
    assert len(sent) <= 2 * size
    back = pickle.loads(sent)
    assert len(back.starts) == 200 * 991 and back.names[7] == ["7"]
    assert sum(x.nbytes for x in vars(back).values() if isinstance(x, np.ndarray)) <= 8 * size


def test_windows_of_a_block():
    rows = [("b", b"a b c a b c a b"), ("a", b"c a b x"), ("a", b"A, b!"), (None, b"x y"), ("e", b"..."), ("f", b"")]
    bench = Benchmark.build(rows, 3)
    word = {k: w for w, k in bench.vocabulary.items()}
    found = {tuple(word[i] for i in bench.ids[s : s + n]): sorted(x for t in bench.texts_of(k) for x in bench.names[t]) for k, (s, n) in enumerate(zip(bench.starts, bench.lengths, strict=True))}
    assert found == {(b"a", b"b", b"c"): ["b"], (b"b", b"c", b"a"): ["b"], (b"c", b"a", b"b"): ["a", "b"], (b"a", b"b", b"x"): ["a"], (b"a", b"b"): ["a"], (b"x", b"y"): []}
    assert bench.nameless.tolist() == [False, False, False, True]


def test_an_item_larger_than_a_block(spark):
    rng = random.Random(2)
    items = [(int(i), t.decode()) for i, t in [*random_items(rng, 1, 3000), *((str(k + 1), t) for k, (_, t) in enumerate(random_items(rng, 6, 20)))]]
    docs = spark.createDataFrame([(1, "x " + " ".join(items[0][1].split()[500:530]) + " y"), (2, items[3][1]), (3, "of its own")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (300, 1 << 20):
        got = {r["doc_id"]: (r["n_hit"], r["items"], r["longest"] and r["longest"]["words"], r["longest"] and r["longest"]["item_start"]) for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect()}
        assert got == {1: (30, ["0"], 30, 500), 2: (20, ["3"], 20, 0), 3: (0, [], None, None)}
