import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines, dup, had = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in had
            had.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def brute_best(words):
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    return best


def test_whole_table(spark, docs_rows):
    got = {r.doc_id: r for r in queries.QUERIES["op9_quality_rules"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs_rows)
    for i, text, _ in docs_rows:
        r = got[i]
        n, chars, sym, dup, rep = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep), i
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=24), min_size=1, max_size=5))
def test_repeat_lengths(texts):
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    sym = np.array([ord(c) for t in texts for c in t], dtype=np.uint64)
    if len(sym):
        assert quality.repeat_lengths(sym, doc).tolist() == [b for t in texts for b in brute_best(t)]


def test_edges(spark, make_docs):
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(None, clean), (1, None), (2, ""), (3, " \n \t"), (4, clean), (4, clean), (5, "x " * 5000),
            (6, clean + " " + clean), (7, "é\x1c\x85 ü\n\né\x1c\x85 ü\n \n \nlast\nlast"),
            (8, " ".join(f"v{i}" for i in range(200_000)))]
    df = make_docs(rows).withColumnRenamed("lang", "m").withColumnRenamed("source", "row")
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        assert (by[i].n_words, by[i].word_chars, by[i].n_symbols, by[i].n_dup_lines, by[i].n_repeat_words) == brute(t)
    assert by[None].kept and by[4].kept and by[8].kept
    assert not any(by[i].kept for i in (1, 2, 3, 5, 6, 7))
    assert by[6].longest_repeat == 60 and [tuple(x) for x in by[6].repeats] == [(0, 120)]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 4
    assert quality.judge(df.limit(0)).collect() == []


def test_chunks_do_not_change_results(monkeypatch, docs_rows):
    texts = pa.array([t for _, t, _ in docs_rows], pa.string())
    whole = quality.measure(texts).to_pylist()
    monkeypatch.setattr(quality.W.chunks, "__defaults__", (1000,))
    assert quality.measure(texts).to_pylist() == whole
