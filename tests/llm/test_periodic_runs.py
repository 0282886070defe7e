import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import periodic_runs as pr
from ledgerline.llm import queries
from ledgerline.llm import words as W


def brute_runs(words):
    """All runs by their definition, one lag at a time."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(start, start + length - p)) for p in range(1, q)):
                out.add((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, words, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def fast(words):
    """The lag scans again, with numpy, for long texts."""
    w = np.array([hash(x) for x in words])
    out = []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate(([0], w[q:] == w[:-q], [0])).astype(np.int8)
        edge = np.diff(same)
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            n = int(e - s) + q
            if n >= max(6, 4 * q) and not any((w[s: s + n - p] == w[s + p: s + n]).all() for p in range(1, q) if q % p == 0):
                out.append((int(s), n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_whole_table(spark, docs_rows):
    got = [tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()]
    want = [expected(i, w := brute(i, t), fast(w)) for i, t, _ in docs_rows]
    assert sorted(got) == sorted(want)
    assert any(r[1] and r[4] > pr.SHORT for r in got) and any(r[1] and r[4] <= pr.SHORT for r in got)


def of(lists):
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    sym = W.random_words(5, 300)[np.array([x for ws in lists for x in ws], dtype=np.int64)]
    first = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    found = pr.runs_of(sym, doc)
    return [[(s - first[d], n, q) for s, n, q in found if first[d] <= s < first[d + 1]] for d in range(len(lists))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_small_alphabets(lists):
    assert of(lists) == [brute_runs(x) for x in lists]


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 90), st.integers(2, 200))
def test_long_periods(rng, q, letters):
    """Repeated pieces of every length, neighbours that break them, nested repeats."""
    lists = []
    for _ in range(3):
        piece = [rng.randrange(letters) for _ in range(q)]
        if rng.random() < 0.3:
            piece = (piece[: max(1, q // 5)] * 6)[: q - 1] + [letters + 1]
        body = (piece * 7)[: rng.randrange(3 * q, 6 * q + 1)]
        lists.append([rng.randrange(letters) for _ in range(rng.randrange(9))] + body + [rng.randrange(letters) for _ in range(9)] + body)
    assert of(lists) == [fast(x) for x in lists]


def test_edges(spark, make_docs):
    rng = random.Random(3)
    long = [f"w{rng.randrange(9)}" for _ in range(3000)]
    rows = [(None, "a b " * 9), (1, None), (2, ""), (3, " \n\x0b"), (4, "a " * 6), (5, "a " * 5), (6, "x y x y\x1c" + " é" * 7),
            (7, " ".join(long * 40)), (8, "a b\t" * 4), (9, "a b c " * 3 + "a b"), (9, "a b c " * 4), (9, "a b c " * 4)]
    df = make_docs(rows).withColumnRenamed("lang", "runs").withColumnRenamed("source", "r").withColumnRenamed("n_chars", "collapsed")
    got = df.select("doc_id", pr.find_runs(F.col("text")).alias("m")).select("doc_id", "m.*").collect()
    assert sorted([(str(r.doc_id), r.n_words, [tuple(x) for x in r.runs]) for r in got]) == sorted(
        (str(i), len(w := (t or "").encode().split()), fast(w)) for i, t in rows)
    by = {r.doc_id: r for r in got}
    assert [tuple(x) for x in by[None].runs] == [(0, 18, 2)] and by[None].collapsed == "a b"
    assert (0, 120_000, 3000) in [tuple(x) for x in by[7].runs]
    assert df.limit(0).select(pr.find_runs(F.col("text"))).collect() == []


def test_query_edges(spark, make_docs, write_sf):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:30]
    rows = [(i, " ".join(f"t{k}" for k in range(1 + 7 * j))) for j, i in enumerate(ids)] + [(None, "a " * 8), (ids[0], None), (ids[1], " "), (ids[1], " ")]
    got = queries.QUERIES["op11_periodic_runs"](spark, write_sf(documents=make_docs(rows))).collect()
    want = [expected(i, w := brute(i, t), fast(w)) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_chunks_do_not_change_results(monkeypatch, docs_rows):
    texts = pa.array([t for _, t, _ in docs_rows], pa.string())
    whole = pr._measured(texts).to_pylist()
    monkeypatch.setattr(W.chunks, "__defaults__", (1000,))
    assert pr._measured(texts).to_pylist() == whole


@pytest.mark.parametrize("words", [["a"] * 600_000, [f"w{i % 70_000}" for i in range(600_000)], ["a", "b"] * 200_000 + ["a"] * 100_000])
def test_long_repetitive_texts_take_seconds(words):
    got = pr._measured(pa.array([" ".join(words)])).to_pylist()[0]["runs"]
    q = {1: 1, 2: 2}.get(len(set(words)), 70_000) if words[0] != words[-1] or len(set(words)) != 1 else 1
    assert got[0]["period"] == q and got[0]["start"] == 0
