import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import line_dedup, queries

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars=40, min_documents=5):
    """[(lines, dropped, kept)] of (id, text) rows; a null id is smaller than all others."""
    order = lambda i: (i is not None, i or 0)
    where = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                where[key(line)].add(i)
    last = {k: max(ids, key=order) for k, ids in where.items() if len(ids) >= min_documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def same(df, rows, **kw):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(df, **kw).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, **kw), key=str)


def test_whole_table(spark, docs_rows):
    got = {r.doc_id: r for r in queries.QUERIES["op13_line_dedup"](spark, "/root/testdata/sf0.001").collect()}
    want = brute([(i, t) for i, t, _ in docs_rows])
    assert len(got) == len(want) and sum(w[2] for w in want) > 0
    for i, lines, dropped, kept in want:
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (lines, dropped, hashlib.sha256(kept.encode()).hexdigest())


LONG = "é" * 39 + "x"       # 40 code points, 79 bytes


def test_edges(spark, make_docs):
    short = "é" * 39
    rows = [(i, f"{LONG}\n{short}\nown {i}\n{LONG}") for i in range(6)]
    rows += [(3, f" \t{LONG.upper().replace('É', 'é')}\r\nrepeated id")]                         # white space, A-Z and an id once more
    rows += [(None, f"null id\n{LONG}"), (None, None), (20, None), (21, ""), (22, "\n\n"), (23, " \n"), (24, "y" * 300_000 + "\n" + LONG)]
    rows += [(i, f"{'four documents only ' * 3}\n{i}") for i in (30, 31, 32, 33, 33)]          # id 33 twice: four documents
    df = make_docs(rows).withColumnRenamed("lang", "k").withColumnRenamed("source", "lost").withColumnRenamed("n_chars", "id")
    same(df, rows)
    got = {(r.doc_id, r.kept) for r in line_dedup.dedup_lines(df).collect()}
    assert (24, "y" * 300_000 + "\n" + LONG) in got and (0, f"{short}\nown 0") in got and (33, f"{'four documents only ' * 3}\n33") in got
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []
    assert line_dedup.dedup_lines(df.where("doc_id in (20, 21)")).count() == 2


def test_hot_line(spark, make_docs):
    """One line in a third of all documents, others in few: both ways of the join."""
    rows = [(i, "\n".join([f"line {j} of some documents {'.' * 30}" for j in range(i % 7)] + [LONG] * (i % 3 == 0) + [f"{i} {LONG}"])) for i in range(3000)]
    rows += [(3000 + i, f"seldom {i // 5} {LONG}") for i in range(50)]
    same(make_docs(rows, 7), rows)


def test_hot_keys_are_broadcast_only_within_their_bound(spark):
    plan = line_dedup._with(spark.range(9).select(F.col("id").alias("a")), spark.createDataFrame([(1, 5)], "a long, rows long"),
                            ["a"], "rows", 9)
    assert [r.a for r in plan.collect()] == [1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \tAaZ\x0bé \x1c\x85", max_size=12).map(lambda s: s.replace("\n", "")), st.integers(0, 6))
def test_line_key(line, least):
    got = line_dedup.line_key(line.encode(), least)
    assert (got is None) == (len(key(line)) < least)
    if got:
        assert got == line_dedup.xxh3_128_digest(key(line).encode())
