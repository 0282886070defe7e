import hashlib
import re

from ledgerline.llm import license_texts as L
from ledgerline.llm import licenses as C
from ledgerline.llm import queries


def canonical(t):
    t = (t or "").lower()
    t = "\n".join(x for x in t.split("\n") if not re.match(
        r"[^\w\n©]*(copyright\s*(\(c\)|©|[0-9])|\(c\)\s*[0-9]|©|all rights reserved)", x))
    t = re.sub(r"[\W_]+", " ", t).strip()
    t = f" {t} "
    for a, b in L.SPELLINGS:
        t = t.replace(a.replace("-", " "), b)
    return t.strip() or None


def sha(t):
    c = canonical(t)
    return c and hashlib.sha256(c.encode()).hexdigest()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    notices = {sha(t): a for a, t in L.NOTICES}
    got = {r.doc_id: r for r in queries.QUERIES["op10_license_scan"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = sorted({notices[sha(x)] for x in (t or "").split("\n") if sha(x) in notices})
        assert (got[i].digest, got[i].named) == (sha(t), ",".join(want)), i
    assert sum(r.n_named for r in got.values()) > 10


def test_known_texts_and_edges(make_docs):
    mit = "Copyright (c) 2020 Someone Else\n\n" + L.MIT
    rows = [(1, mit), (2, L.MIT.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ;")), (3, "  MIT Licence!\n(c) 1999 A. B.\n" + L.MIT),
            (4, L.MIT + " more"), (5, None), (6, ""), (7, "?!"), (8, "x\n* Released under the MIT Licence *\nReleased under the MIT license\ny"),
            (None, L.ZLIB), (9, L.ZERO_BSD), (9, L.ZERO_BSD), (10, L.APACHE_NOTICE.replace("http:", "https:")), (11, "w " * 100_000),
            (12, L.TEXTS[9][1]), (13, L.TEXTS[7][1])]
    df = make_docs(rows).withColumnRenamed("lang", "digest").withColumnRenamed("source", "license")
    got = C.scan(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {i: by[i].license for i in by if by[i].license} == {
        1: "MIT", 2: "MIT", 3: "MIT", None: "Zlib", 9: "0BSD", 10: "Apache-2.0", 12: "BSD-3-Clause", 13: "BSD-2-Clause"}
    assert by[8].named == ["MIT"] and all(by[i].digest is None for i in (5, 6, 7))
    assert C.scan(df.limit(0)).collect() == []


def test_copyright_lines_without_sign_or_year(make_docs):
    heads = ["Copyright Jane Doe 2020", "Copyright Foo Inc. and contributors", "  COPYRIGHT: The Foo Authors", "# copyright by me\n# All rights reserved"]
    rows = [(i, f"MIT License\n\n{h}\n\n{L.MIT}") for i, h in enumerate(heads)] + [(10, f"{heads[0]}\n{L.TEXTS[9][1]}")]
    rows += [(20, "Copyright notice: none\n" + L.MIT), (21, "copyrighted by me\n" + L.MIT), (22, "Copyright Jane Doe")]
    got = {r.doc_id: r for r in C.scan(make_docs(rows)).collect()}
    assert {i: got[i].license for i in got} == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 10: L.TEXTS[9][0], 20: None, 21: None, 22: None}
    assert all(got[i].digest == sha(t) for i, t in rows)


def test_whole_texts_by_digest(make_docs):
    text = "A long licence of many words"
    rows = [(1, text.upper()), (2, "Copyright Jane Doe\n" + text), (3, text + " more")]
    got = {r.doc_id: r.license for r in C.scan(make_docs(rows), digests=[("Long-1.0", sha(text))]).collect()}
    assert got == {1: "Long-1.0", 2: "Long-1.0", 3: None}
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Apache-2.0", "CC0-1.0"} <= {a for a, _ in L.DIGESTS}


def test_sql_gives_the_licences_of_planted_texts(make_docs, write_sf):
    """The SQL beside the operator where whole texts, digests and copyright lines matter."""
    import duckdb
    heads = ["", "Copyright (c) 2020 A", "Copyright Jane Doe 2020", "  COPYRIGHT: The Foo Authors", "# copyright by me\n# All rights reserved",
             "Copyright notice: none", "copyrighted by me", "Copyright holders of this", "© 1999 B", "copyright", "Copyright\tthe law of"]
    rows = [(100 * n + m, f"{h}\n{t}\n") for n, (_, t) in enumerate(L.TEXTS) for m, h in enumerate(heads)]
    rows += [(9000, None), (9001, ""), (9002, "Released under the MIT Licence\nx"), (9003, "Copyright Jane Doe")]
    sf = write_sf(documents=make_docs(rows))
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op10_license_scan"](make_docs(rows).sparkSession, sf).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    want = {r[0]: r for r in con.execute(queries.ORACLES["op10_license_scan"]).fetchall()}
    assert got == want
    assert sum(r[2] is not None for r in got.values()) > 80 and len({r[2] for r in got.values()}) > 6
