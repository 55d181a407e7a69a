"""Very long texts that repeat themselves."""

import hashlib
import random

import numpy as np
import pytest

from fathomtext.llm import substring_dedup
from fathomtext.llm.substring_dedup import ANCHOR, LENGTH, text_regions


@pytest.mark.parametrize("text", ["a" * 3_000_000, "xyz" * 700_000, ("".join(random.Random(1).choice("abcdef ") for _ in range(5000)) + "\n") * 300])
def test_rows_do_not_grow_with_repeats(text):
    found = text_regions(memoryview(text.encode()), LENGTH, ANCHOR)
    assert len(found[0]) < 2000
    a, b, c = found[0], found[1], found[6]
    covered = np.zeros(len(text), dtype=bool)
    for lo, hi in zip(a[c == 0].tolist(), b[c == 0].tolist(), strict=True):
        covered[lo : hi + LENGTH] = True
    # what is cut off at an edge of the text or of a chunk is decided with the other texts
    assert covered.mean() > 0.999 and c.sum() >= len(text) // LENGTH


def test_long_repeats_beside_others(spark, monkeypatch):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = noise(900)
    rows = [(1, "z" * 1_500_000), (2, noise(2000) + "z" * 700 + noise(500)), (3, shared * 3 + noise(300)), (4, noise(100) + shared), (5, noise(3000)), (6, "z" * 300), (7, ("pq" * 300) + noise(50))]
    monkeypatch.setattr(substring_dedup, "CHUNK", 1 << 16)  # contexts meet again over chunks
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = {i: t.encode() for i, t in rows}
    count = {}
    for i, t in texts.items():
        for k in range(0, len(t) - LENGTH + 1):
            if i == 1 and k > 2:
                break
            count[t[k : k + LENGTH]] = count.get(t[k : k + LENGTH], 0) + 1
    for i, t in texts.items():
        gone = np.zeros(len(t), dtype=bool)
        if i == 1:
            gone[:] = True
        else:
            for k in range(len(t) - LENGTH + 1):
                if count[t[k : k + LENGTH]] > 1:
                    gone[k : k + LENGTH] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (int(gone.sum()), hashlib.sha256(kept).hexdigest()), i
