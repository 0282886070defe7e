import re

import corpus_pipeline as P
import test_decontaminate as td
import test_minhash_dedup as tm
import test_mixing as tx
import test_quality as tq
import test_secrets as ts


def brute(rows, items):
    """The stages on (doc_id, text, source), with the brute-force forms of each operator's tests."""
    def good(t):
        n, _, _, _, rep = tq.brute(t)
        if n < 20 or 100 * rep > 30 * n:
            return False
        best = tq.quality.repeat_lengths(*words(t))
        cover = {j for i, b in enumerate(best) if b >= 5 for j in range(i, i + b)}
        return len(cover) <= 0.4 * n and (max(best) <= 50 or max(best) <= 0.25 * n)

    def words(t):
        import numpy as np
        w = tq.WORD.findall(t)
        code = {x: i for i, x in enumerate(dict.fromkeys(w))}
        return np.array([code[x] for x in w], dtype=np.uint64), np.zeros(len(w), np.int64)

    rows = [r for r in rows if r[1] and good(r[1])]
    comp = tm.brute([(i, t) for i, t, _ in rows], percent=80)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    bad = {r[0] for r in td.brute([(i, t) for i, t, _ in rows], items) if r[5]}
    rows = [r for r in rows if str(r[0]) not in bad]
    out = []
    for i, t, s in rows:
        found, new, at = ts.spans(t), "", 0
        for a, _, b, _ in found:
            if a >= at:
                new += t[at:a] + "[secret]"
            at = max(at, b)
        out.append((i, new + t[at:], s))
    return out


def test_stages_against_brute_force(spark, docs_rows):
    sf = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, x = docs.columns, docs
    for _, stage in P.STAGES[:-1]:
        x = stage(spark, x, sf).checkpoint()
        assert x.columns == columns
    want = brute(docs_rows, items)
    assert sorted((r.doc_id, r.text, r.source) for r in x.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in x.collect() if "[secret]" in r.text)
    mix = P.run(spark, sf)
    assert mix.columns == [*columns, "copies"]
    got = mix.collect()
    sizes = {}
    for _, t, s in want:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    goal = tx.brute_targets(sizes)
    for s, target in goal.items():
        taken = sum(r.copies * len(r.text.split()) for r in got if r.source == s)
        longest = max(len(t.split()) for _, t, s2 in want if s2 == s)
        assert abs(taken - target) <= longest
    assert {r.doc_id for r in got} <= {i for i, _, _ in want} and {r.copies for r in got} <= {1, 2}


def test_stages_take_odd_rows(spark, make_docs, write_sf):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, text + " token = abcdefabc", None), (5, "short")]
    df = make_docs(rows)
    sf = write_sf(documents=df, benchmark=spark.createDataFrame([(1, "not there at all in any of them")], "item_id long, text string"))
    odd = df.selectExpr("doc_id", "text", "lang as row", "source", "n_chars", "1 as copies", "2 as key", "3 as id")
    for docs in (df, odd, odd.limit(0)):
        x = docs
        for _, stage in P.STAGES:
            y = stage(spark, x, sf).checkpoint()
            assert set(docs.columns) <= set(y.columns)
            x = y
        ids = sorted(str(r.doc_id) for r in x.collect())
        assert ids in ([], ["3", "None"], ["3"], ["None"])
