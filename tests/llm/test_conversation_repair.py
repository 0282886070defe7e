import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import conversation_repair as cr
from ledgerline.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    """{conv_id: rows after damage, sorted}, by the contract's words."""
    out = {}
    for i, t, r, x in rows:
        mine = out.setdefault(i, [])
        show = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{show(i)}:{show(t)}".encode()) % 20
        r, x = show(r), show(x)
        if k == 0:
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        mine += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return {i: sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode())) for i, v in out.items()}


def flags(rows):
    seen, out = set(), []
    for _, r, x in rows:
        body = x.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (r, x) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((r, x))
    return out


def cheapest(rows, fault):
    """(cost, audit) by recursion over rows and states; long conversations from their end."""
    memo = {}
    due = {"0": "u", "s": "u", "u": "a", "a": "u"}

    def best(i, state, inserts):
        key = (i, state, inserts)
        if key not in memo:
            options = []
            if i == len(rows):
                if state in "0a":
                    options.append((0, ""))
            else:
                c, a = best(i + 1, state, 0)
                options.append((c + 2, "D" + a))
                if fault[i] not in ("blank", "duplicate"):
                    more = 5 * (fault[i] == "truncated")
                    k = rows[i][1][:1]
                    if k == due[state] or (k == "s" and state == "0"):
                        c, a = best(i + 1, k, 0)
                        options.append((c + more, "K" + a))
                    c, a = best(i + 1, due[state], 0)
                    options.append((c + more + 1, "R" + a))
            if inserts < 3:
                c, a = best(i, due[state], inserts + 1)
                options.append((c + 5, "I" + a))
            memo[key] = min(options, default=(10**9, ""))
        return memo[key]

    for i in range(len(rows), -1, -1):
        for state in "0sua":
            for k in (3, 2, 1, 0):
                best(i, state, k)
    return best(0, "0", 0)


def edited(rows, audit):
    out, i = [], 0
    for c in audit:
        turn_due = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if c == "I":
            out.append((turn_due, ""))
            continue
        if c in "KR":
            out.append((rows[i][1] if c == "K" else turn_due, rows[i][2]))
        i += 1
    return out


def brute(conv_id, rows):
    fault = flags(rows)
    cost, audit = cheapest(rows, fault)
    out = edited(rows, audit)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (conv_id, gaps, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    want = sorted([brute(i, v) for i, v in damage(rows).items()], key=str)
    got = queries.QUERIES["op12_conversation_repair"](spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert rows_of(got) == want
    assert {c for w in want for c in w[7]} == set("DKR")       # deleting is always cheaper than an insert


@lru_cache(None)
def sequences(n):
    """Edit strings over n rows with at most two inserts at a place."""
    gap = ["", "I", "II"]
    if n == 0:
        return gap
    return [g + e + rest for g in gap for e in "KRD" for rest in sequences(n - 1)]


def exhaustive(rows, fault):
    best = None
    for audit in sequences(len(rows)):
        out = edited(rows, audit)
        if not re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
            continue
        cost, i, ok = 0, 0, True
        for c in audit:
            cost += {"K": 0, "R": 1, "D": 2, "I": 5}[c]
            if c != "I":
                if c != "D":
                    cost += 5 * (fault[i] == "truncated")
                    ok &= fault[i] not in ("blank", "duplicate")
                i += 1
        if ok and (best is None or (cost, audit) < best):
            best = (cost, audit)
    return best


def paths(convs, ends=None):
    """least_paths over conversations of (role, text) rows."""
    first, fault, kind = [0], [], []
    for c in convs:
        f, k = cr.faults([r for r, _ in c], [x for _, x in c], set())
        fault, kind = fault + f, kind + k
        first.append(len(fault))
    n = len(convs)
    a, c = cr.least_paths(np.array(fault, np.int64), np.array(kind, np.int64), np.array(first), np.tile(cr.AT_END, (n, 1)),
                          np.ones(n, bool), np.zeros(n, np.int64))
    return list(zip(c.tolist(), a))


ROW = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "x"]), st.sampled_from(["", "a.", "b.", "c", "d!", "e"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(ROW, max_size=4), min_size=1, max_size=3))
def test_against_all_edit_sequences(convs):
    rows = [[(None, *r) for r in c] for c in convs]
    want = [exhaustive(r, flags(r)) for r in rows]
    assert paths(convs) == want
    assert [cheapest(r, flags(r)) for r in rows] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ROW, max_size=40), min_size=1, max_size=6))
def test_against_recursion(convs):
    rows = [[(None, *r) for r in c] for c in convs]
    assert paths(convs) == [cheapest(r, flags(r)) for r in rows]


def long_conversation(n, seed):
    rng = random.Random(seed)
    texts = [f"say {k}{e}" for k in range(max(3, n // 3)) for e in (".", "", "!")] + [" "]
    return [(rng.choice([None, *range(n // 2)]) if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool"]),
             rng.choice(texts)) for _ in range(n)]


def test_pieces(spark):
    """Conversations cut into many pieces, by size and by the edges of tasks, give what whole ones give."""
    rows = [(i, *r) for i, n in ((1, 700), (2, 3), (3, 260), (4, 1), (7, 90), (None, 120)) for r in long_conversation(n, n)]
    rows += [(10 + i, t, "user" if t % 2 == 0 else "assistant", f"{i} {t}.") for i in range(40) for t in range(4)]
    rows += [(99, 0, "system", "s."), (98, 0, "user", " "), (97, None, None, None)]
    want = sorted([brute(i, v) for i, v in damage(rows).items()], key=str)
    df = cr.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5))
    for size in (1, 7, 64, cr.PIECE_ROWS):
        got = cr.repair(df, lost=F.col("lost"), piece_rows=size)
        assert rows_of(got.report) == want
    by = {}
    for r in sorted(got.turns.collect(), key=lambda r: (str(r.conv_id), r.part, r.seq, r.pos)):
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    empty = hashlib.sha256(b"").hexdigest()
    assert {w[0]: w[-1] for w in want} == {w[0]: hashlib.sha256("\n".join(by.get(w[0], [])).encode()).hexdigest() for w in want}
    assert any(w[-1] == empty for w in want)


def test_edges(spark):
    rows = [(1, 0, "user", "x" * 200_000 + "."), (1, 1, "assistant", "a."), (2, None, None, None), (3, 5, "", "é\x1c"), (3, 5, "", "é\x1c"),
            (4, 9, "user", "hi.\x85"), (None, None, "user", "no id."), (5, 1, "system", "only."), (6, -3, "a", "b?"), (6, 4, "u", "c!")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"lost": F.lit(True), "id": F.lit(1), "part": F.lit(2), "seq": F.lit("s")})
    want = {}
    for i, t, r, x in rows:
        want.setdefault(i, []).append((t, " " if r is None else r, " " if x is None else x))
    got = cr.repair(df)
    assert rows_of(got.report) == sorted([brute(i, v) for i, v in want.items()], key=str)
    assert cr.repair(df.limit(0)).report.collect() == []
    lost = cr.repair(df, lost=F.col("lost")).report.collect()
    assert {tuple(r)[1:] for r in lost} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(lost) == 7
