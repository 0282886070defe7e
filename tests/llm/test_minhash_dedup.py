import random
import re

import numpy as np
import pytest

from ledgerline.llm import minhash_dedup as D
from ledgerline.llm import queries
from ledgerline.llm import words as W
from ledgerline.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    """{id: (n, component)} by comparing every pair."""
    s = {}
    for i, t in rows:
        if i is not None:
            s.setdefault(i, shingles(t))
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(s)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if s[i] and s[j] and 100 * min(len(s[i]), len(s[j])) >= percent * max(len(s[i]), len(s[j])):
                both = len(s[i] & s[j])
                if 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i)) for i in ids}


def test_whole_table(spark, docs_rows):
    got = queries.QUERIES["op2_minhash_dedup"](spark, "/root/testdata/sf0.001").collect()
    want = brute([(i, t) for i, t, _ in docs_rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(docs_rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert any(not r.kept for r in got)


def variants(rng, base, n, low, high, first):
    out = []
    for i in range(n):
        w = base[:]
        for _ in range(rng.randint(low, high)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def large_groups():
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = variants(rng, base, 150, 0, 14, 1000)            # a large group, many of them not linked to its hub
    far = base[:]
    for i in range(0, 200, 14):
        far[i] = f"far{i}"
    rows += variants(rng, far, 60, 0, 3, 500)               # a second group in the same buckets
    chain = [f"c{i}" for i in range(120)]
    for i in range(30):                                     # neighbours are linked, ends are not
        rows.append((2000 + i, " ".join(chain)))
        chain[(i * 7) % 120] = f"x{i}"
    rows += [(3000 + i, "Same TEXT in every one of these rows") for i in range(300)]
    return rows


def test_large_groups_and_edges(spark, make_docs, large_groups, monkeypatch):
    monkeypatch.setattr(D, "SMALL_BUCKET", 10)
    monkeypatch.setattr(D, "BLOCK_MEMBERS", 40)
    rows = large_groups + [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"),
                           (None, "one two"), (None, None), (7, "a b c d e f"), (7, "a b c d e f"),
                           (8, " ".join(f"v{i}" for i in range(60_000))), (9, " ".join(f"v{i}" for i in range(60_001)))]
    df = make_docs(rows).withColumnRenamed("lang", "id").withColumnRenamed("source", "n")
    got = D.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = D.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert ids.count(None) == 2
    assert D.near_duplicates(df.limit(0)).collect() == [] and D.keep_one(df.limit(0)).collect() == []


def test_signature_agrees_with_similarity():
    rng = np.random.default_rng(1)
    both, one, two = rng.integers(0, 2**63, 800), rng.integers(0, 2**63, 100), rng.integers(0, 2**63, 100)
    h = np.concatenate([np.sort(np.concatenate([both, x])).astype(np.uint64) for x in (one, two)])
    s = D.min_max(h, np.array([0, 900, 1800]))
    assert abs((s[:, 0] == s[:, 1]).mean() - 0.8) < 0.15


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(500, 400), (400, 400)], "a long, b long")
    got = {r.id: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(301)}, 400: 400, 500: 400}


def test_word_fingerprints_follow_the_words():
    a = W.split(*W.buffer(__import__("pyarrow").array(["The the x\x1cy", None, "", " THE", "é"])), W.SPACED)
    assert a.counts.tolist() == [3, 0, 0, 1, 1]
    assert a.hashes[0] == a.hashes[1] == a.hashes[3] and len(set(a.hashes.tolist())) == 3


def test_keep_one_at_80_percent(make_docs):
    # n words with the last d exchanged: J = (n - 4 - d) / (n - 4 + d)
    rows = []
    for g in range(30):
        words = [f"g{g}w{i}" for i in range(104)]
        rows += [(4 * g + m, " ".join(words[:104 - d] + [f"g{g}x{m}y{i}" for i in range(d)])) for m, d in enumerate((0, 9, 11, 13))]
    sets = {i: shingles(t) for i, t in rows}
    for percent, kept in ((80, [30, 0, 0, 30]), (85, [30, 30, 30, 30])):
        want = set()
        for i, s in sets.items():
            first = sets[i - i % 4]
            if i % 4 == 0 or 100 * len(s & first) < percent * len(s | first):
                want.add(i)
        got = {r.doc_id for r in D.keep_one(make_docs(rows), k=5, percent=percent).collect()}
        assert got == want and [sum(i % 4 == m for i in got) for m in range(4)] == kept
    assert D.bands_for(85) == 20 and D.bands_for(80) == 28 and (1 - 0.8 ** D.ROWS) ** D.bands_for(80) <= D.MISS


def test_keep_one_judges_each_text_of_an_id(make_docs):
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abczy"}
    rows = [(1, "a"), (1, "b"), (2, "c"), (3, "c"), (3, "z"), (3, "z"), (None, "a"), (9, "y")]
    got = D.keep_one(make_docs([(i, text[c]) for i, c in rows], parts=4), percent=80).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in got) == [("1", "a"), ("1", "b"), ("2", "c"), ("3", "z"), ("9", "y"), ("None", "a")]
    near = text["c"].replace("c0 ", "new ")                   # a near copy under an id that holds other texts too
    rows = [(1, text["a"]), (2, text["c"] + " c40" * 9), (1, near + " c40" * 9), (1, text["b"])]
    got = D.keep_one(make_docs(rows, parts=2), percent=80).collect()
    got = {(r.doc_id, r.text) for r in got}
    assert len(got) == 3 and {rows[0], rows[3]} < got
