import hashlib
import re

from ledgerline.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    out.sort()
    n = [sum(x[3] == k for x in out) for k in ("email", "ip", "card", "phone")]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in out)
    return (*n, hashlib.sha256(joined.encode()).hexdigest()), joined


def digest(r):
    return (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)


def test_whole_table(spark, docs_rows):
    got = {r.doc_id: r for r in queries.QUERIES["op5_pii"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs_rows) and sum(r.n_email + r.n_card for r in got.values()) > 0
    for i, t, _ in docs_rows:
        want, joined = brute(t)
        assert digest(got[i]) == want, i
        assert set(joined.split(",")) <= set(got[i].spans.split(",")) or not joined


EDGES = [None, "", "a@b", "a@b.c", "a@b.c_d@e.f", "a@b.c..d@e.f", "a@b-.c.d. x", "@a.b a@.b a@b. a@b..c", "é😀a.b+c@d.e é😀 1.2.3.4",
         "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.0255 0000001.2.3.4 99999999999999999999.1.1.1 1.2.3", "4111 1111 1111 1111",
         "4111-1111-1111-1111 4111  1111", "4111 1111 1111 1112", "12345678901234567890", "+1 (743) 555-3824", "+1--.. 5", "++12345678901 +12",
         "+123456789012345678", "5500005555555559 - 1", "0000 0000 0000", "x" * 3000 + "@" + "a" * 3000, "a@b" + ".c" * 40000,
         "1 " * 20000, "+1" + " 2" * 50000, "1.1.1.1 " * 5000, "9" * 3000]


def test_edges(spark, make_docs, write_sf):
    rows = [(None if k == 1 else k, t) for k, t in enumerate(EDGES)] + [(2, "a@b.c")]
    sf = write_sf(documents=make_docs(rows).withColumnRenamed("lang", "base").withColumnRenamed("source", "key"))
    got = queries.QUERIES["op5_pii"](spark, sf).collect()
    assert sorted(map(str, ((r.doc_id, *digest(r)) for r in got))) == sorted(map(str, ((i, *brute(t)[0]) for i, t in rows)))
    assert pii.scan(make_docs(rows).limit(0)).collect() == []


def test_bootstrapped_identifiers(make_docs):
    card = ["4111111111111111", "5500005555555559", "4012888888881881", "6011111111111117", "5105105105105100", "4222222222222222003"[:16]]
    rows = [(i, f"Dear client, card number: {c} thanks") for i, c in enumerate(card)]
    rows += [(10, "your card number: 4111111111111112 was declined"), (11, "Card  number: 4111111111111112"),
             (12, "part number: 4111111111111112"), (13, "in the year 1234567"), (14, "in the year 1234567")]
    got = {r.doc_id: r for r in pii.scan(make_docs(rows)).collect()}
    assert [(x.s, x.e, x.t) for x in got[10].ids] == [(18, 34, "4111111111111112")]
    assert [(x.s, x.e) for x in got[11].ids] == [(14, 30)]
    assert all(got[i].ids == [] for i in (12, 13, 14))


def found(make_docs, rows):
    return {r.doc_id: [x.t for x in r.ids] for r in pii.scan(make_docs(rows)).collect()}


def test_contexts_discover_other_shapes(make_docs):
    rows = [(i, f"please write to contact: user{i}@mail.example.org today") for i in range(4)]
    rows += [(10 + i, f"logged in from host 10.1.2.{i} again") for i in range(4)]
    rows += [(20 + i, f"you may call +1 (743) 555-382{i} now") for i in range(4)]
    want = {30: ("contact:", "@jane_doe"), 31: ("contact:", "jane.doe"), 32: ("contact:", "CUST-0099812"), 33: ("to contact:", "P1234567"),
            34: ("from host", "fe80-17/node_4"), 35: ("from host", "db7.intern"), 36: ("may call", "(743) 555-3824"),
            37: ("may call", "0049 30 123456"), 38: ("may call", "skype_9921")}
    rows += [(i, f"see 77 you write to {c} {t}, thanks" if c.startswith("contact") else f"see {c} {t}, thanks") for i, (c, t) in want.items()]
    rows += [(50, "write to contact: somebody"), (51, "part CUST-0099812 in stock"), (52, "12345678 12345679x")]
    got = found(make_docs, rows)
    assert {i: got[i] for i in want} == {i: [t] for i, (_, t) in want.items()}
    assert got[50] == got[51] == got[52] == [] and all(got[i] == [] for i in range(24) if i in got)


def test_unlabelled_are_no_negatives(make_docs):
    rows = [(i, f"our account holder: u{i}@ex.org") for i in range(3)] + [(3, "our account holder: AB-123456")]
    rows += [(100 + i, f"client mail: u{i}@ex.org") for i in range(100)] + [(300 + i, f"client mail: ZX{i:06d}") for i in range(40)]
    rows += [(400 + i, f"seen in u{i}@ex.org") for i in range(3)] + [(410 + i, f"seen in {1990 + i}") for i in range(2)]
    rows += [(420, "seen in AB-777777")] + [(430 + i, f"only two u{i}@ex.org") for i in range(2)] + [(440, "only two AB-888888")]
    got = found(make_docs, rows)
    assert got[3] == ["AB-123456"]
    assert all(got[300 + i] == [f"ZX{i:06d}"] for i in range(40))
    assert got[420] == [] and got[440] == []
    assert not any(got[i] for i in (*range(3), *range(100, 200), 400, 410, 411))


def test_no_upper_lengths(make_docs):
    """Identifiers and context words of any length."""
    long_id, word = "CUST-" + "4711-" * 200 + "99", "www" * 70
    rows = [(i, f"our account holder: u{i}@ex.org") for i in range(3)] + [(10, f"our account holder: {long_id} of old")]
    rows += [(20 + i, f"see {word} u{i}@ex.org") for i in range(3)]
    rows += [(30, f"see {word} AB-123456"), (31, f"xx {word} AB-123457"), (32, f"see {word}w AB-123458")]
    got = found(make_docs, rows)
    assert got[10] == [long_id] and got[30] == ["AB-123456"] and got[31] == got[32] == []


def test_long_text_with_many_spans(make_docs):
    text = "write to contact: u1@ex.org and to contact: AB-99812345 at 10.0.0.1\n" * 17_000
    rows = [(i, f"write to contact: v{i}@ex.org") for i in range(4)] + [(9, text)]
    got = {r.doc_id: r for r in pii.scan(make_docs(rows)).collect()}[9]
    assert len(got.base) == 34_000 and len(got.ids) == 17_000
    assert all(text[x.s: x.e] == x.t for x in (*got.base[::997], *got.ids[::991]))
    # the same text in one short copy of each line gives the same spans a line
    line = len(text) // 17_000
    assert {(x.s % line, x.e - x.s) for x in got.ids} == {(text.index("AB-"), len("AB-99812345"))}


TOKEN, GROUPS = (re.compile(p, re.ASCII) for p in (pii.TOKEN, pii.GROUPS))


def matches(pattern, text, keep=lambda t: True):
    """(start, end, match, last two words of the gap before it) of all matches; ``keep`` filters afterwards."""
    out, at = [], 0
    for m in pattern.finditer(text):
        left = re.search(r"(?:\S+\s+)?\S*\s*\Z", text[at: m.start()][-4000:], re.ASCII)[0]
        if keep(m[0]):
            out.append((m.start(), m.end(), m[0], left))
        at = m.end()
    return out


def context(left):
    import regex
    after = re.sub(f"(?s)^.*(?:{pii.TOKEN}|{pii.HIDDEN})", "", left, count=1, flags=re.ASCII)
    words = re.search(r"(?:(\S+)\s+)?(\S+)[\s]*$", after.lower(), re.ASCII)
    return re.sub(r"\s+", " ", regex.sub(r"^[^\p{L}]+", "", words[0].strip(" ") if words else ""), flags=re.ASCII)


def digits(t):
    return re.sub("[^0-9]", "", t)


def brute_ids(texts, rounds=pii.ROUNDS):
    """{text: spans of kind id}: the pattern-instance graph with dictionaries."""
    seen = {}
    for text in set(texts):
        found = [(m.start(), m.end(), m[0], p) for p in (EMAIL, IP, CARD, PHONE) for m in p.finditer(text)]
        base, masked = [], list(text)
        for p, ok in ((EMAIL, lambda t: True), (IP, lambda t: all(int(x) <= 255 for x in t.split("."))),
                      (CARD, lambda t: 12 <= len(digits(t)) <= 19 and luhn(digits(t))), (PHONE, lambda t: 9 <= len(digits(t)) <= 15)):
            base += matches(p, text, ok)
        assert len(base) <= len(found)
        for s, e, _, _ in base:
            masked[s:e] = pii.HIDDEN * (e - s)
        groups = matches(GROUPS, "".join(masked), lambda t: re.search(r"[\x20()]", t) and len(digits(t)) >= pii.MIN_CHARS)
        for s, e, _, _ in groups:
            masked[s:e] = pii.HIDDEN * (e - s)
        # contexts of groups come from the text before groups are hidden
        tokens = matches(TOKEN, "".join(masked), lambda t: re.search(r"[0-9@_%+]|\.[A-Za-z0-9]", t))
        seen[text] = [(s, e, t, context(left), seed) for spans, seed in ((base, True), (groups + tokens, False)) for s, e, t, left in spans]
    edges = {}
    for rows in seen.values():
        for _, _, t, c, seed in rows:
            if c:
                edges[c, t] = edges.get((c, t), False) or seed
    of = {}
    for (c, t), seed in edges.items():
        of.setdefault(c, {})[t] = seed
    non = {(c, t) for (c, t), seed in edges.items() if not seed and len(t) < pii.MIN_CHARS}
    able = {c: ts for c, ts in of.items() if sum(ts.values()) >= pii.MIN_SEEDS
            and len(ts) > sum(ts.values()) + sum((c, t) in non for t in ts)}
    score = {}
    for ts in able.values():
        for t, seed in ts.items():
            score[t] = max(score.get(t, 0.0), float(seed))
    trusted = {}
    for _ in range(rounds):
        trusted = {}
        for c, ts in able.items():
            known = sum(score[t] >= pii.MIN_SCORE for t in ts)
            p = known / (known + sum((c, t) in non for t in ts) + pii.PRIOR)
            if p >= pii.MIN_SCORE:
                trusted[c] = p
        new = {}
        for t in score:
            mine = [c for c, ts in able.items() if t in ts]
            own = max(float(able[c][t]) for c in mine)
            miss = 1.0
            for c in mine:
                miss *= 1 - min(trusted.get(c, 0.0), 1 - 1e-9)
            new[t] = max(own, 0.0 if any((c, t) in non for c in mine) else 1 - miss)
        score = new
    good = {(c, t) for c in trusted for t, seed in able[c].items() if not seed and (c, t) not in non and score[t] >= pii.MIN_SCORE}
    return {text: sorted({(s, e) for s, e, t, c, seed in rows if not seed and (c, t) in good}) for text, rows in seen.items()}


def test_identifiers_of_the_whole_table(make_docs, docs_rows):
    """The method over the whole table, with contexts and identifiers planted among its texts."""
    rows = [(i, t if i % 3 else f"{t}\nwrite to contact: AB-{i:05d}/x or user {i}, contact: u{i}@ex.org, from host 10.0.{i % 9}.{i % 7}, from host db{i % 5}.intern")
            for i, t, _ in docs_rows if t]
    got = {r.doc_id: [(x.s, x.e) for x in r.ids] for r in pii.scan(make_docs(rows)).collect()}
    want = brute_ids([t for _, t in rows])
    assert got == {i: want[t] for i, t in rows}
    assert sum(map(len, got.values())) > 50
