"""Each operator against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing column names."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomtext.llm import byte_bpe, decontaminate, exact_dedup, html_text, line_dedup, near_dedup, pii, simhash, substring_dedup, token_counts, toxicity
from fathomtext.llm.shared import materialize

SCHEMA = "doc_id long, text string, keep_id string, row string, fp string, digest string, id string, name string, component string"


def table(spark, rows, schema=SCHEMA):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + ("x",) * (width - len(r)) for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["the", "of", "Straße", "data", "naïve", "line", "x1", "中文", "and", "tail"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 200]))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(prose)]
    rows += [(100, None), (101, ""), (102, prose[3]), (103, prose[3]), (104, prose[4] + " Extra"), (None, prose[3]), (None, None), (105, " \t\n"), (102, prose[3]), (106, "word " * 20_000), (107, "a\nB\n b \n" * 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return materialize(table(spark, texts), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_exact_dedup(docs, texts, none):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    want = collections.Counter()
    for i, t in texts:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want[i, keep, len(groups[t or ""]), i == keep, sha(t or "")] += 1
    assert bag(exact_dedup.exact_dedup(docs)) == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_perfect_hash_is_minimal_and_byte_checked():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (5000, 4), dtype=np.int64).astype("<u8")
    index = exact_dedup.PerfectHash(words)
    assert sorted(index.slots(words)) == list(range(5000))
    back = exact_dedup.PerfectHash.unpack(**index.pack())
    assert (back.slots(words) == index.slots(words)).all()
    near = words.copy()
    near[:, 0] += np.uint64(1)
    import pandas as pd

    shard = exact_dedup.build_shard(pd.DataFrame({"shard": 0, "digest": [w.tobytes() for w in words], "winner": range(5000), "n": 1}))
    found = exact_dedup.look_up(pd.DataFrame({"digest": [w.tobytes() for w in [*words[:10], *near[:10]]], "winner": -1, "n": 1}), shard)
    assert list(found["member"]) == [True] * 10 + [False] * 10 and list(found["winner"][:10]) == list(range(10))


def test_line_dedup(docs, texts, none):
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    key = lambda line: lower(line).strip(" \t\n\x0b\f\r")
    for least in (2, 4):
        count = collections.Counter(k for _, t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
        want = collections.Counter()
        for i, t in texts:
            lines = (t or "").split("\n")
            kept = [x for x in lines if count[key(x)] < least]
            want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
        assert bag(line_dedup.line_dedup(docs, least)) == want
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_plan_is_native(docs):
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def brute_components(points, bits=3):
    root = {p: p for p in points}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in points:
        for b in points:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in points}


def test_simhash(docs, texts, none):
    fps = [(i, brute_fingerprint(t)) for i, t in texts]
    comp = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        least[comp[f]] = min((x for x in (least.get(comp[f]), i) if x is not None), default=None)
    want = collections.Counter((i, f"{f:016x}", least[comp[f]]) for i, f in fps)
    got = simhash.near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert bag(got) == want
    assert simhash.near_groups(none).count() == 0


@pytest.mark.parametrize("crowd", [2048, 4])
def test_simhash_links_lose_no_component(spark, crowd):
    rng = random.Random(crowd)
    points = {rng.getrandbits(64) for _ in range(40)}
    for p in list(points)[:10]:
        for _ in range(12):
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
            points.add(p)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in points}
    found = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), crowd=crowd)
    roots = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    want = brute_components(points)
    groups = collections.defaultdict(set)
    for p in points:
        groups[want[p]].add(roots.get(signed[p], signed[p]))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_dedup_keeps_one_of_each_group(spark, none):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, bases = [], []
    for g in range(12):
        base = [word() for _ in range(300)]
        bases.append(g * 10)
        for k in range(5):
            copy = list(base)
            if k:
                copy[rng.randrange(300)] = word()
            rows.append((g * 10 + k, " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "only two"), (1003, "only three words"), (None, rows[0][1])]
    docs = materialize(table(spark, rows), "near")
    kept = sorted((r["doc_id"] for r in near_dedup.drop_near_copies(docs).collect()), key=lambda x: (x is None, x))
    assert kept == [*bases, 1000, 1002, 1003, None]
    small, near_dedup.SMALL = near_dedup.SMALL, 2
    try:
        assert near_dedup.drop_near_copies(docs).count() == len(kept)
    finally:
        near_dedup.SMALL = small
    assert near_dedup.drop_near_copies(none).count() == 0


def test_html_wrappers_and_other_languages():
    prose = "The story of the town is told in a book that was found by the river and is read to this day. " * 4
    want = " ".join(prose.split())
    for wrap in ("<div class='content-sidebar-wrap'>{}</div>", "<div class='has-sidebar'>{}</div>", "<form action='x'>{}</form>"):
        for body in (f"<article><p>{prose}</p></article>", f"<p>{prose}</p>"):
            page = wrap.format(f"{body}<nav>Home About</nav><div class='sidebar'>Latest and more</div>")
            assert html_text.main_text(f"<html><body>{page}</body></html>") == want
    finnish = " ".join(["Vanha kaupunki sijaitsee joen rannalla ja sen historia ulottuu keskiajalle asti."] * 4)
    assert html_text.main_text(f"<body><nav>Etusivu</nav><div><p>{finnish}</p></div></body>") == finnish


def edited_copies(rng, word, pairs):
    """doc_id, text of bases and, at doc_id + 1, a copy with words appended, cut off or replaced; ids step by 10."""
    rows = []
    for g in range(pairs):
        n = rng.choice([80, 300, 900])
        base, share = [word() for _ in range(n)], rng.uniform(0.02, 0.24)
        copy = list(base)
        if g % 3 == 0:
            copy += [word() for _ in range(int(n * share))]
        elif g % 3 == 1:
            copy = copy[: n - int(n * share * 0.9)]
        else:
            for k in rng.sample(range(n), max(1, int(n * share / 10))):
                copy[k] = word()
        rows += [(g * 10, " ".join(base)), (g * 10 + 1, " ".join(copy))]
    return rows


def jaccard(a, b):
    return len(a & b) / len(a | b)


def stays_right(rows, kept):
    """No two of those kept are similar, and each document dropped is similar to one of them."""
    sets = {i: set(near_dedup.shingles(t.encode()).tolist()) for i, t in rows}
    alike = {(i, k) for i in sets for k in kept if i != k and jaccard(sets[i], sets[k]) >= near_dedup.SIMILARITY}
    return not any(i in kept for i, _ in alike) and all(i in kept or any(x == i for x, _ in alike) for i in sets)


def test_near_dedup_finds_every_edited_copy(spark):
    rng = random.Random(11)
    line = " ".join(f"common{k}" for k in range(12))
    rows = [(i, f"{t} {line}") for i, t in edited_copies(rng, lambda: "".join(rng.choice("abcdefghij") for _ in range(6)), 150)]
    kept = {r["doc_id"] for r in near_dedup.drop_near_copies(materialize(table(spark, rows), "edited")).collect()}
    assert stays_right(rows, kept)


def test_near_dedup_decides_chains_and_large_groups(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(6):
        stream = [word() for _ in range(400)]
        order = rng.sample(range(40), 40)
        rows += [(g * 100 + order[k], " ".join(stream[k * 4 : k * 4 + 100])) for k in range(40)]
    kept = {}
    small = near_dedup.SMALL
    try:
        for near_dedup.SMALL in (small, 3):
            kept[near_dedup.SMALL] = {r["doc_id"] for r in near_dedup.drop_near_copies(materialize(table(spark, rows), "chains")).collect()}
    finally:
        near_dedup.SMALL = small
    assert kept[small] == kept[3] and stays_right(rows, kept[small])


def test_byte_bpe(docs, texts, none):
    import public_tokenizers
    import tiktoken

    ours = byte_bpe.ByteBPE(*byte_bpe.public_table())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    rng = random.Random(1)
    for n in [0, 1, 2, 15, 16, 17, 18, 300, 5000]:
        for _ in range(20 if n < 5000 else 1):
            t = "".join(rng.choice("abcdeth éß中 \n1'") for _ in range(n))
            assert list(memoryview(ours.encode(t)).cast("I")) == theirs.encode_ordinary(t)
            assert ours.decode(ours.encode(t)) == t.encode()
    want = collections.Counter()
    for i, t in texts:
        ids = np.array(theirs.encode_ordinary(t or ""), dtype="<u4").tobytes()
        want[i, len(ids) // 4, sha(ids), sha(t or "")] += 1
    assert bag(byte_bpe.bpe(docs, keep_ids=False)) == want
    whole = byte_bpe.bpe(docs).first()
    assert len(whole["ids"]) == 4 * whole["n_tokens"] and sha(whole["decoded"]) == whole["decoded_sha256"]
    assert byte_bpe.bpe(none).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def confirmed(kind, match):
    d = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return True


def test_pii(spark, texts, none):
    cases = [
        "a@b.c_d@e.f a@b.c@d.e x..y@z..q.r m@n.o. 1.2.3.4.5.6.7.8 300.1.1.1.2 01.002.3.255 1.2.3.4.a", "4111 1111 1111 1111  4111-1111-1111-1111 4111111111111111- 4111--1111 +1 (555) 123-4567. +1555",
        "é𝄞 a.b@c.de é +44 20 7946 0958)) x", "1" * 3000 + " " + "a" * 3000 + "@" + "b." * 3000 + " " + "1 " * 6000 + "+1" + "2 " * 6000, "@a.b a@.b a@b. a@-.- a@b.-c.d+x@y.z%%@q.w", "-1-2--3- 4 5  6 +1.2.3.4.5.6.7.8.9.0",
        "card 4111 1111 1111 1111 4111 1111 1111 1111",
    ]
    rows = [*texts, *((200 + i, t) for i, t in enumerate(cases)), (300, "iban GB82WEST12345698765432, GB82WEST12345698765433")]
    want = collections.Counter()
    for i, t in rows:
        spans = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "", re.A) if confirmed(kind, m[0]))
        want[i, ",".join(s[2] for s in spans)] += 1
    got = pii.pii(table(spark, rows))
    base = F.filter("spans", lambda s: s["kind"] != "iban")
    assert bag(got.select("doc_id", pii.listed(base))) == want
    bank = got.where("doc_id = 300").first()["spans"]
    assert [(s["kind"], s["start"], s["end"], s["score"]) for s in bank] == [("iban", 5, 27, 1.0)]
    assert pii.pii(none).count() == 0


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, names = words(text), set(), set()
    for name, t in items:
        w = words(t)
        k = min(window, len(w))
        wins = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(doc) - k + 1 if w else 0):
            if tuple(doc[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                names.add(str(name))
    return len(doc), len(hit), len(names), sorted(names), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontaminate(spark, docs, texts, none, block):
    items = [(1, texts[5][1]), (2, " ".join(texts[7][1].split()[2:14])), (3, "中文"), (4, None), (None, "data"), (5, "..."), (10, "x1 tail"), (1, texts[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(i, t) for i, t in items if i is not None and t is not None]
    want = collections.Counter((i, *(tuple(x) if isinstance(x, list) else x for x in brute_hits(t, known))) for i, t in texts)
    got = decontaminate.decontaminate(docs, bench, block_bytes=block).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    assert collections.Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in got.collect()) == want
    clean = decontaminate.drop_contaminated(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def brute_removed(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        yield len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), sha(kept)


@pytest.mark.parametrize("crowd", [512, 3])
def test_substring_dedup(spark, none, crowd):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(80):
        parts = [rng.choice([rng.choice(base)[rng.randint(0, 100) : rng.randint(150, 300)], "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(200, None), (201, "xy" * 200), (202, "a" * 500), (203, rows[5][1]), (None, "short"), (203, rows[5][1])]
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, brute_removed([(t or "").encode() for _, t in rows], 40), strict=True))
    docs = materialize(table(spark, rows), "substrings")
    assert bag(substring_dedup.substring_dedup(docs, 40, 12, crowd).drop("kept")) == want
    if crowd == 3:
        assert substring_dedup.substring_dedup(none).count() == 0


def test_suffix_array_runs():
    rng = random.Random(4)
    for _ in range(100):
        ts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        for length in (1, 3, 8):
            count = collections.Counter(t[i : i + length] for t in ts for i in range(len(t) - length + 1))
            want = [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in ts]
            assert [x.tolist() for x in substring_dedup.repeated_starts(ts, length)] == want


def test_token_counts(spark, docs, texts, none, tmp_path):
    assert bag(token_counts.count_tokens(docs)) == bag(byte_bpe.bpe(docs, keep_ids=False).select("doc_id", "n_tokens"))
    assert token_counts.count_tokens(none).count() == 0
    rng, want = np.random.default_rng(1), {}
    for k, (n, p) in enumerate([(1000, 0.02), (0, 0.1), (37, 0), (64, 1), (3000, 0.001), (16, 0.5)]):
        ids = np.where(rng.random(n) < p, 9, 1).astype("<u2")
        ids.tofile(tmp_path / f"f{k}")
        ends = np.flatnonzero(ids == 9).tolist()
        found = list(zip([0, *(e + 1 for e in ends)], ends, [True] * len(ends), strict=False))
        last = ends[-1] + 1 if ends else 0
        want[f"f{k}"] = [(a, b - a, t) for a, b, t in [*found, *([(last, n, False)] if last < n else [])]]
    for block in (64, 1000, 1 << 20):
        got = collections.defaultdict(dict)
        for r in token_counts.scan(spark, f"file://{tmp_path}", eod=9, block_bytes=block).collect():
            got[r["file"]][r["ordinal"]] = (r["start"], r["n_tokens"], r["terminated"])
        assert {f: [v[i] for i in range(len(v))] for f, v in got.items()} == {f: v for f, v in want.items() if v}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script><style>p{}</style></head><body>
<header><p>Site of the name and the slogan that is here for all of the pages to see and to read</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad -->
<div class="ad">Buy the best of the best and the rest of it now for you and for your friends in the city</div>
<article class="post"><div class="post-header"><h1>The &amp; title</h1></div><p><b>First of the paragraphs&nbsp;in   the
page.<br><p>Short.</p><p>It is the second one and it is longer than the other one that was in the page before it.</p>
<aside class="sidebar"><p>Of the side and of the bar and the rest of it</p></aside><div class="cookie-notice">We use the cookies of the site</div>
<section id="comments"><p>I think that the article is the best of all that I have read on the site so far, and that is that.</p></section></article>
<article class="comment"><p>It is the best of the articles that I have read on the site in the last of the years</p></article>
<form><p>Sign up for the news of the week and the day</p></form><footer>&copy; the site</footer></body></html>"""


def test_html_text(spark):
    want = "The & title First of the paragraphs in the page. Short. It is the second one and it is longer than the other one that was in the page before it."
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "plain words"), (4, "x", "<article><p>Ein Wort</p></article"), (1, "u", PAGE)]
    got = html_text.extract(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == sorted([("1", want, len(want)), ("1", want, len(want)), ("2", "", 0), ("None", "", 0), ("3", "", 0), ("4", "Ein Wort", 8)])
    prose = "It is the story of the man who was in the city and of the things that he did for the people that were there with him in the days of the war. " * 3
    page = f"<body><div><a href=x>One</a> <a href=y>Two</a></div><p>{prose}</p><p>Yes, he did.</p><p>{prose}</p><div>Tags: a, b</div></body>"
    assert html_text.main_text(page) == " ".join([prose.strip(), "Yes, he did.", prose.strip()])


def test_toxicity_on_held_out_texts(spark, none):
    rng = random.Random(7)
    bad = ["idiot", "moron", "scum"]
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(400):
        w = [word() for _ in range(rng.randint(20, 120))]
        if i % 4 == 0:
            for _ in range(max(2, len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
    docs = table(spark, [*rows, (1000, None), (1001, ""), (None, rows[0][1])], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1 - (i % 8 == 0), int(i % 4 == 0)) for i in range(200)] + [(5, None, 0), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.learn(docs, labels, toxicity.CHAIN)
    got = {r["doc_id"]: r["rejected"] for r in toxicity.classify(docs, chain).collect()}
    wrong = [i for i in range(200, 400) if got[i] != (i % 4 == 0)]
    assert len(wrong) <= 4 and not got[1000] and not got[1001] and got[None]
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not x for x in got.values())
    empty = toxicity.learn(docs, labels.limit(0), toxicity.CHAIN)
    assert toxicity.classify(docs, empty).where("rejected").count() == 0
    assert toxicity.classify(none, chain).count() == 0


def test_chain_feeds_out_of_fold_predictions_forward():
    rng = np.random.default_rng(0)
    n = 600
    first = rng.integers(0, 2, n)
    x = toxicity.Sparse(np.arange(n + 1), first.astype(np.int64), np.full(n, 0.05))
    labels = np.stack([first, first], axis=1)
    chain = toxicity.train(toxicity.Sparse(np.arange(0, 2 * n + 1, 2), np.c_[first, 100 + np.arange(n)].ravel().astype(np.int64), np.full(2 * n, 0.05)), labels, ["a", "b"], {0: {"0x"}, 1: {"0y"}})
    assert chain.links[1].shape == (1,) and chain.links[1][0] > 0 and x is not None
    p = chain.probabilities(np.array([[w[k] * 0.05 for k in range(2)] for w in (chain.weights["0x"], chain.weights["0y"])]))
    assert p[1, 1] > 0.5 > p[0, 1]


@pytest.fixture
def unsteady(spark, monkeypatch):
    """From one written table to the next the session splits files differently, as a cluster does that gains and loses executors."""
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before, turn = {n: spark.conf.get(n, None) for n in names}, [0]

    def shift(df, name, write=materialize):
        turn[0] += 1
        for n, values in zip(names, (("1", "16", "4"), ("64m", "2k", "700"), ("4m", "1", "1")), strict=True):
            spark.conf.set(n, values[turn[0] % 3])
        return write(df, name)

    for module in (substring_dedup, decontaminate, line_dedup, exact_dedup):
        monkeypatch.setattr(module, "materialize", shift)
    yield turn
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def test_substring_dedup_while_the_cluster_changes(spark, unsteady, tmp_path):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([rng.choice(base)[: rng.randint(50, 200)], str(rng.random())]) for _ in range(4))) for i in range(300)]
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.option("parquet.block.size", 4096).option("parquet.page.size", 512).option("parquet.page.size.row.check.min", 10).parquet(path)
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, brute_removed([t.encode() for _, t in rows], 40), strict=True))
    assert bag(substring_dedup.substring_dedup(spark.read.parquet(path), 40, 12).drop("kept")) == want and unsteady[0] > 3


def test_stages_leave_clashing_columns_alone(spark, docs, texts):
    names = ["__id", "__digest", "__gone", "own", "key", "fp", "n", "lead"]
    wide = docs.select("doc_id", "text", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in names))
    for stage in (exact_dedup.drop_copies, near_dedup.drop_near_copies):
        kept = stage(materialize(wide, "wide"))
        assert kept.columns == wide.columns
        assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in kept.collect() for c in names)


def test_large_ids_beside_missing_ones(spark):
    big = 2**53 + 1
    rows = [(big, "same"), (big - 2, "same"), (None, "none"), (None, "same"), (-big, "alone")]
    got = {(r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(big, big), (big - 2, big), (None, None), (None, big), (-big, -big)}


def test_later_links_learn_from_out_of_fold_predictions():
    """Words that occur in one fold only: seen in training they give the category away, outside they tell nothing."""
    n, rng = 600, np.random.default_rng(3)
    group = np.arange(n) % 5 * 3 + np.arange(n) // 5 % 3
    y = rng.permutation(15)[group] % 2
    x = toxicity.Sparse(np.arange(n + 1), group.astype(np.int64), np.full(n, 0.05))
    w, _, b = toxicity.fit(x, np.empty((n, 0)), y.astype(float))
    inside = toxicity.logit(toxicity.sigmoid(x.dot(w) + b))
    assert ((inside > 0) == y).all()
    _, in_sample, _ = toxicity.fit(x, inside[:, None], y.astype(float))
    chain = toxicity.train(x, np.stack([y, y], axis=1), ["a", "b"], {})
    assert in_sample[0] > 0.5 and chain.links[1][0] < 0.2 * in_sample[0]


def test_toxicity_with_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 40, f"{'bad' if i % 2 else 'good'} word{i % 7} text") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    chain = toxicity.learn(docs, labels, toxicity.CHAIN)
    assert toxicity.classify(docs, chain).count() == 4000


def test_stages_on_empty_tables(spark, none, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.learn(none, labels, toxicity.CHAIN)
    assert toxicity.drop_toxic(none, chain).count() == exact_dedup.drop_copies(none).count() == near_dedup.drop_near_copies(none).count() == 0
    items = spark.createDataFrame([(1, "data")], "item_id long, text string")
    assert decontaminate.drop_contaminated(none, items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_decontaminate_over_blocks_while_the_cluster_changes(spark, unsteady, tmp_path):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([4, 12, 30])))) for k in range(60)]
    items += [(None, "w1 w2 w3"), (100, items[0][1]), (101, items[0][1])]
    rows = []
    for i in range(120):
        cut = rng.choice(items)[1].split()
        rows.append((i % 100, " ".join([*(rng.choice(words) for _ in range(rng.randint(0, 30))), *cut[: rng.randint(0, len(cut))], rng.choice(words)])))
    rows += [(500, None), (501, "")]
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.option("parquet.block.size", 2048).option("parquet.page.size", 512).option("parquet.page.size.row.check.min", 10).parquet(path)
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(k, t) for k, t in items if k is not None]
    want = {False: collections.Counter(), True: collections.Counter()}
    for i, t in rows:
        some, every = brute_hits(t, named), brute_hits(t, [*named, ("none", "w1 w2 w3")])
        want[False][i, some[0], some[1], some[2], tuple(some[3])] += 1
        want[True][i, every[0], every[1], every[2], tuple(n for n in every[3] if n != "none")] += 1
    for nameless in (False, True):
        for block in (1 << 20, 1500):
            docs = spark.read.parquet(path)
            got = decontaminate.decontaminate(docs, bench, block_bytes=block, nameless=nameless)
            assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"])) for r in got.collect()) == want[nameless]
            assert decontaminate.drop_contaminated(docs, bench, block_bytes=block, nameless=nameless).count() == sum(n for k, n in want[nameless].items() if not k[2])


def test_longest_matches():
    rng = np.random.default_rng(6)
    for _ in range(30):
        parts, items = ([rng.integers(0, 3, rng.integers(1, 30)) for _ in range(rng.integers(1, 5))] for _ in range(2))
        words, at, item, place = decontaminate.longest_matches(parts, items)
        for k, x in enumerate(parts):
            found = {tuple(y[a : a + n]) for y in items for n in range(1, len(y) + 1) for a in range(len(y) - n + 1)}
            want = max((n for n in range(1, len(x) + 1) for a in range(len(x) - n + 1) if tuple(x[a : a + n]) in found), default=0)
            assert words[k] == want
            if want:
                assert tuple(x[at[k] : at[k] + want]) == tuple(items[item[k]][place[k] : place[k] + want])


def test_equal_items_do_not_multiply():
    text = " ".join(f"w{k}" for k in range(12))
    bench = decontaminate.Benchmark.build([(f"i{k:04}", text.encode()) for k in range(3000)], 10)
    assert len(bench.starts) == 3
    import pyarrow as pa

    found = list(decontaminate.shard_hits(pa.array([" x ".join([text] * 2000)]), bench, 10))
    assert found[0][0] == 2000 * 12 + 1999 and len(found[0][1]) == 2000 and len(found[0][2]) == 3000 and found[0][4]["words"] == 12


PROSE = "The story of the town is told in a book that was found by the river and is read to this day. "


def test_html_odd_markup():
    page = "<body><article><p>{}</p>{}<p>{}</p></article></body>"
    first, last = (PROSE * 4).strip(), (PROSE * 3).strip()
    for odd in ("<svg/>", "<svg class=x />", "<iframe src='x'/>", "<noscript>", '<p class="x></p>', '<p title="a <b> c"></p>', "<script>var x = '<p>';</script>", "<!-- <p> -->"):
        assert html_text.main_text(page.format(first, odd, last)) == f"{first} {last}", odd
    for part, want in (
        ("<section class='alert-systems'><p>Yes.</p></section>", "Yes."), ("<p><a href=x>One</a></p><p>No.</p><p><a href=y>Two</a></p>", "One No. Two"), ("<div class='share-prices'>Up.</div>", "Up."),
        ("<div class='cookie-notice'>Off</div>", ""), ("<div class='site-sidebar left-col'>Off</div>", ""), ("<div id='relatedArticles'>Off</div>", ""), ("<div class='x ad-container'>Off</div>", ""),
    ):
        assert html_text.main_text(page.format(first, part, last)) == " ".join(x for x in (first, want, last) if x), part


def test_html_generated_pages():
    """Pages made from known parts: the article's paragraphs come back whole and in order, whatever stands around and between."""
    rng = random.Random(21)
    words = "the of and to in a is that it for on with as was by this are from river town book story light house Straße 中文 x1".split()
    noise = ["<nav><ul><li><a href=/>Home</a></li></ul></nav>", "<header><p>Site</p></header>", "<footer>&copy; all</footer>", "<div class='ad'>Buy the best of it</div>", "<aside>More of it</aside>", "<form><p>Sign up for the news</p></form>", "<script>x='</p>'</script>", "<div class='comments'><p>I think that it is the best</p></div>", "<svg/>", "<!-- x -->"]
    within = [x for x in noise if not x.startswith("<header")]  # an article's own header belongs to it
    for _ in range(150):
        paragraphs = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 12, 60]))) for _ in range(rng.randint(1, 8))]
        body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<p><a href=x>{}</a></p>", "<p><b>{}</b></p>"]).format(p) + rng.choice(["", "", rng.choice(within)]) for p in paragraphs)
        page = f"<html><body>{''.join(rng.sample(noise, 4))}<article>{body}</article>{''.join(rng.sample(noise, 4))}</body></html>"
        assert html_text.main_text(page) == " ".join(paragraphs), page


def test_html_time_grows_with_the_page():
    import time

    for made in (lambda n: "<b class=menu>" * n + "x" + "</i>" * n, lambda n: "<div class=menu>x" * n, lambda n: "<svg>x" * n, lambda n: "<p>x</q>" * n):
        took = []
        for n in (10_000, 40_000):
            best = 9e9
            for _ in range(2):
                began = time.process_time()
                html_text.main_text(made(n))
                best = min(best, time.process_time() - began)
            took.append(best)
        assert took[1] < 9 * took[0] + 0.1, took


def test_a_model_that_tells_nothing_rejects_nothing():
    y = np.arange(200) % 10 == 0
    assert toxicity.best_threshold(np.full(200, 0.6), y.astype(int)) == 1.0
    assert toxicity.best_threshold(np.where(y, 0.4, 0.6), y.astype(int)) == 1.0
    assert 0.4 < toxicity.best_threshold(np.where(y, 0.6, 0.4), y.astype(int)) < 0.6


@pytest.mark.parametrize("spread", [64, 18, 8])
def test_large_buckets_are_indexed_again_without_loss(spread):
    rng = random.Random(spread)
    points = {rng.getrandbits(64) & ((1 << spread) - 1) for _ in range(60)}
    for p in list(points):
        for _ in range(4):
            points.add(p ^ 1 << rng.randrange(spread) ^ 1 << rng.randrange(spread))
    members = np.array(sorted(points), dtype=np.uint64)
    want, root = brute_components(points), {p: p for p in points}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for u, v in simhash.joined(members, 3, crowd=8):
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            assert (a ^ b).bit_count() <= 3
            root[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for p in points:
        groups[want[p]].add(find(p))
    assert all(len(g) == 1 for g in groups.values())
