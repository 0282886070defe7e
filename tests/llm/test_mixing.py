import re

from ledgerline.llm import mixing as M
from ledgerline.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, share=1.5, top=2):
    """sizes: {source: words}; null (None) last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= top * sizes[s]}
        if not over:
            out.update({s: left * w[s] / total for s in open_})
            break
        for s in over:
            out[s] = float(top * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(rows, docs):
    by = {}
    for d, t, s in docs:
        by.setdefault(s, []).append(len(WORD.findall(t or "")))
    want = brute_targets({s: sum(v) for s, v in by.items()})
    assert len(rows) == len(docs)
    src = {(d, s) for d, _, s in docs}
    taken = {}
    source = {d: s for d, s in src}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sum(by[s]) and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(by[s]), (s, n, want[s], max(by[s]))
    return taken, want


def test_whole_table(spark, docs_rows):
    q = queries.QUERIES["op7_mixing"]
    a = q(spark, "/root/testdata/sf0.001").collect()
    check(a, docs_rows)
    b = q(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_edges(spark, make_docs):
    docs = [(i, "w " * (i % 50 + 1), "hot") for i in range(2000)]
    docs += [(2001, None, None), (2002, "a b", None), (2003, "", "empty"), (2004, "\x0b x\x0cy\t", "Ä"), (2005, "one", "Z")]
    docs += [(3000 + i, "same text here", "ties") for i in range(30)]
    df = make_docs(docs).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "u")
    rows = M.mix(df).collect()
    taken, want = check(rows, docs)
    assert abs(taken["hot"] - want["hot"]) <= 50
    got = M.mixed(df)
    assert got.select("row.*").columns == df.columns
    copies = {r.row.doc_id: r.copies for r in got.collect()}
    assert copies == {r.doc_id: r.copies for r in rows if r.copies}
    assert M.mix(df.limit(0)).collect() == []
    nothing = make_docs([(1, None, "a"), (2, "", None)])
    assert [r.taken for r in M.mix(nothing).collect()] == [0, 0]
    repeated = make_docs([(None, "x y z", "a"), (None, "x y z", "a"), (5, "x y z", "b")])
    assert sorted(r.size for r in M.mix(repeated).collect()) == [3, 3, 3]


def test_pareto_inclusion_follows_the_weights(make_docs):
    docs = [(i, "w " * (4 if i % 2 else 100), "b") for i in range(3000)] + [(9000, "w " * 100, "a")]
    rows = [r for r in M.mix(make_docs(docs)).collect() if r.doc_id < 9000]
    assert {r.copies for r in rows} == {1, 2}           # one certain copy, a sampled second one
    rate = {k: sum(r.copies - 1 for r in rows if r.size == k) / 1500 for k in (4, 100)}
    assert rate[4] > 1.5 * rate[100] > 0
