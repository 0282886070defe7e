import hashlib
import re

from pyspark.sql import types as T

from ledgerline.llm import decontaminate as D
from ledgerline.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[j:j + 13]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                got = wins.get(tuple(w[j:j + n]))
                if got:
                    hit.update(range(j, j + n))
                    ids |= got
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((str(d), len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_whole_table(spark, docs_rows):
    sf = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(queries.QUERIES["op4_decontamination"](spark, sf))
    assert got == brute([(i, t) for i, t, _ in docs_rows], items)
    assert any(r[5] for r in got)


def test_edges(spark, make_docs, write_sf):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, None), (3, ""), (4, "Solo"), (5, "two words"), (6, " ".join(f"w{i}" for i in range(5, 17))),
             (7, long), (None, "null id item"), (1, "a a a a a a a a a a a a a a a"), (9, "ö-ß É x"), (10, "!!")]
    docs = [(1, long), (2, long.upper().replace(" ", ", ")), (3, None), (4, ""), (5, "..."), (6, "x solo y"),
            (7, "two, WORDS two"), (8, "pad " * 300 + long + " pad" * 500), (9, "a " * 40), (9, "a " * 40),
            (None, long + " " + long), (11, "w0 w1 w2 w3 w4 w5"), (12, "null id item"), (13, "ö ß É x"), (14, "solo"),
            (15, " ".join(f"w{i % 40}" for i in range(20000)))]
    bench = spark.createDataFrame(items, ITEMS)
    sf = write_sf(documents=make_docs(docs).withColumnRenamed("lang", "key").withColumnRenamed("source", "win"), benchmark=bench)
    want = brute(docs, items)
    assert rows(queries.QUERIES["op4_decontamination"](spark, sf)) == want
    df = spark.read.parquet(f"{sf}/documents.parquet")
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(r[0] for r in want if not r[5])
    assert D.search(df.limit(0), bench).collect() == []
    assert D.drop_contaminated(df, bench.limit(0)).count() == len(docs)
