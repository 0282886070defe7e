import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import lm_scoring as M
from ledgerline.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [*WORD.findall((t or "").translate(FOLD)), None]


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7


def brute(rows, order=2):
    """Contract columns and model scores, with plain dictionaries and exact EM."""
    def grams(t, k):
        seq = ["<b>"] * (order - 1) + tokens(t)
        return [tuple(seq[j - k + 1: j + 1]) for j in range(order - 1, len(seq))]

    def model(docs):
        c = [Counter(g for _, t in docs for g in grams(t, k + 1)) for k in range(order)]
        return c, sum(c[0].values()), len(c[0])

    def estimates(t, c, n, docs):
        by_order = [grams(t, k + 1) for k in range(order)]

        def context(k, g):
            return n if k == 0 else docs if set(g[:-1]) == {"<b>"} else c[k - 1][g[:-1]]
        return [[(c[k][g[j]], context(k, g[j])) for k, g in enumerate(by_order)] for j in range(len(by_order[0]))]

    train = [r for r in rows if fold(r[0]) != 2]
    rest = [r for r in train if fold(r[0]) != 3]
    gone = [r for r in train if fold(r[0]) == 3]
    c0, n0, v0 = model(rest)
    ev = [e for _, t in gone for e in estimates(t, c0, n0, len(rest))]
    cells = np.array([[x for a, n in e for x in (0 if not n else min(1 + int(math.log2(n)), M.BUCKETS - 1),
                                                 round(8 * math.log2(a / n)) if a and n else M._NONE)] for e in ev]).reshape(len(ev), -1)
    lam = M.learn(cells, np.ones(len(ev)), order, v0)
    c, n, v = model(train)
    out = []
    for i, t in rows:
        score = base = known = 0
        est = estimates(t, c, n, len(train))
        for e in est:
            p = 1 / (v + 1)
            for k, (a, ctx) in enumerate(e):
                w = lam[k][0 if not ctx else min(1 + int(math.log2(ctx)), M.BUCKETS - 1)]
                p = w * (a / ctx if ctx else 0) + (1 - w) * p
            score += math.log10(p)
            base += math.log10((e[0][0] + 1) / (n + v + 1))
            known += e[0][0] > 0
        out.append((str(i), fold(i) == 2, len(est), known, n, base, score))
    return sorted(out)


def compare(got, want):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6, abs=1e-9)


def test_whole_table(spark, docs_rows):
    got = queries.QUERIES["op3_lm_scoring"](spark, "/root/testdata/sf0.001").collect()
    compare(got, brute([(i, t) for i, t, _ in docs_rows]))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)       # better on texts it never saw


@pytest.mark.parametrize("order", [1, 2])
def test_small_blocks_and_edges(spark, make_docs, monkeypatch, order):
    monkeypatch.setattr(M, "RANGE_KEYS", 8)
    rows = [(i, f"The cat {i % 5} sat ON the mat\n{'x ' * (i % 4)}") for i in range(60)]
    rows += [(100, None), (101, ""), (None, "\x0b \t"), (None, None), (102, "the the THE " * 300), (103, "a b"), (103, "a b"), (104, "é\x1c b")]
    df = make_docs(rows).withColumnRenamed("lang", "id").withColumnRenamed("source", "fold")
    compare(M.score(df, order=order, block_bytes=200).collect(), brute(rows, order))
    assert M.score(df.limit(0)).collect() == []


def test_probabilities_sum_to_one(spark, make_docs):
    """Over all continuations of a context the model gives at most one."""
    rows = [(i, "a b a c a b d") for i in range(40)]
    df = make_docs(rows + [(900 + k, f"a {w}") for k, w in enumerate("abcd")])
    got = M.score(df).collect()
    assert all(r.score < 0 for r in got)
    lam = M.learn(np.array([[9, -8, 5, -2]] * 10), np.ones(10), 2, 5)
    assert 0 <= lam.min() and lam.max() <= 1


def test_three_orders_beat_one(spark, docs_rows, make_docs):
    df = make_docs([(i, t) for i, t, _ in docs_rows])
    total = {k: sum(r.score for r in M.score(df, order=k).collect() if r.held_out) for k in (1, 3)}
    assert total[3] > total[1]
