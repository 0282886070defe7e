import hashlib
import re

from ledgerline.llm import queries
from ledgerline.llm import secrets as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")


def spans(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def brute(text):
    out = spans(text)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in out)
    n = [sum(x[3] == k for x in out) for k in ("assign", "access", "hex")]
    return (*n, hashlib.sha256(joined.encode()).hexdigest())


def test_whole_table(spark, docs_rows):
    got = {r.doc_id: r for r in queries.QUERIES["op6_secret_scan"](spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r.n_assign for r in got.values()) > 0
    for i, t in rows:
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute(t), i


KEY = "AKIA" + "Z" * 16
BARE = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5hJ7k"
EDGES = [None, "", "token=abcdef", "TOKEN : 'abc'", "Api_Key\"  =\" x.y/z=", "apikey:12345 apikey:123456", "token==token=secret=abcdefgh",
         "password\n= abcdefg", KEY, KEY[:-1], "xAKIAAKIA" + "A" * 12, "0" * 23 + " " + "a" * 24 + "g" + "b" * 30, "é😀 token = \"" + "f" * 40 + '"',
         "passſwd=abcdefg Kapi_Key=abcdefg", "token" + " " * 60000 + "= abcdef", "a" * 100000, "token=abcdef " * 6000]


def test_edges(spark, make_docs, write_sf):
    rows = [(None if k == 1 else k, t) for k, t in enumerate(EDGES)] + [(2, EDGES[2])]
    sf = write_sf(documents=make_docs(rows).withColumnRenamed("lang", "base").withColumnRenamed("source", "weak"))
    got = queries.QUERIES["op6_secret_scan"](spark, sf).collect()
    assert sorted(str((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got) == sorted(
        str((i, *brute(t))) for i, t in rows)
    df = make_docs(rows)
    assert S.scan(df.limit(0)).collect() == []
    clean = {(r.doc_id, r.text): r for r in S.redact(df).collect()}
    assert len(clean) == len({(i, re.sub("x", "x", t or "") if t else t) for i, t in rows})
    for r in clean.values():
        assert not spans(r.text) and (r.text is None or r.n_chars == len(r.text))
    assert (3, EDGES[3]) in clean and (12, "é😀 [secret]\"") in clean and (0, None) in clean


def kinds(rows, distance=S.DISTANCE):
    return {r.doc_id: [x.kind for x in r.linked] for r in rows}


def test_linking(make_docs):
    pad = "w " * 200
    rows = [(1, f"user: bob pwd = hunter2 at https://db.example.org/x"), (2, "user: bob"), (3, f"use {BARE} here"),
            (4, f"{KEY} {BARE}"), (5, f"{KEY} {pad} {BARE}"), (6, f"see https://a.example.org {pad} user: bob"),
            (7, f"pwd: hunter2 https://a.example.org"), (8, f"user: bob, token = abcdefgh"), (9, "user: bob pwd = hunter2 " * 2000)]
    got = kinds(S.scan(make_docs(rows)).collect())
    assert got[1] == [S.IDENTIFIER, S.SECRET, S.PLACE]
    assert got[2] == got[3] == got[5] == got[6] == got[7] == []
    assert got[4] == [S.SECRET] and got[8] == [S.IDENTIFIER]
    assert len(got[9]) == 4000


def test_interval_join_is_exact(spark, make_docs):
    rows = []
    for gap in range(0, 60):
        rows.append((gap, "z" * (gap % 7) + " user: bob" + " " * (gap + 1) + "pwd=hunter2"))
        rows.append((1000 + gap, "z" * (gap % 11) + " pwd=hunter2" + " " * (gap + 1) + "user: bob"))
    got = kinds(S.scan(make_docs(rows), distance=25).collect())
    for i, kind in got.items():
        assert (kind != []) == (i % 1000 + 1 <= 25), i


def test_long_parts_are_whole(make_docs):
    fill = lambda n: (BARE * (n // len(BARE) + 1))[:n]
    rows, want = [], {}
    for n in (300, 5000):
        for m, (head, tail) in enumerate([(f"{KEY} ", ""), ("login: bob pwd = ", ""), ("pwd = hunter2 login: ", ""),
                                          ("login: bob pwd = hunter2 https://", "")]):
            i = 10 * n + m
            rows.append((i, f"see {head}{fill(n)}{tail} end"))
            want[i] = len(f"see {head}") + n
    got = {r.doc_id: max(x.e for x in r.linked) for r in S.scan(make_docs(rows)).collect()}
    assert got == want
    for r in S.redact(make_docs(rows)).collect():
        assert BARE[:8] not in r.text and r.text.endswith("[secret] end") and r.n_chars == len(r.text)


def test_many_findings_in_long_texts(make_docs):
    """Texts of 1 MB and more with tens of thousands of findings take time in proportion to their length."""
    line = "password = hunter2x; login: bob pwd = xyzzy1 at https://h.example.org/é😀\n"
    rows = [(n, "start " + line * k + "end") for n, k in enumerate((10, 14_000, 60_000))]
    got = {r.doc_id: r for r in S.redact(make_docs(rows)).collect()}
    clean = "[secret]; [secret] [secret] at [secret]\n"
    for n, k in enumerate((10, 14_000, 60_000)):
        assert got[n].text == "start " + clean * k + "end" and got[n].n_chars == len(got[n].text)


def test_overlapping_findings_become_one(make_docs):
    rows = [(1, "token=abcdef0123456789abcdef012345/AKIA" + "B" * 30 + " x"), (2, "AKIA" + "C" * 20 + "a" * 30 + "z"),
            (3, "a" * 24 + "token=abcdefg"), (4, "x" * 1023 + " token=" + "é" + "b" * 2000 + " token=" + "c" * 3000)]
    got = {r.doc_id: r.text for r in S.redact(make_docs(rows)).collect()}
    for i, t in rows:
        want, at = "", 0
        for a, _, b, _ in spans(t):
            if a >= at:
                want += t[at:a] + "[secret]"
            at = max(at, b)
        assert got[i] == want + t[at:]
