"""Positions of all regex matches as DataFrame expressions.

``find`` gives every leftmost non-overlapping match of a pattern with its
place in code points: the text is cut into (gap, match) pairs by two
``regexp_extract_all`` calls, and the running lengths are the positions.
Patterns must not capture, and should scan single-character classes only (no repeated groups, which
Java matches recursively); ``\\G`` in a pattern is the end of the match before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,t:string,left:string>"
BLOCK = 64
CHUNK = 1024            # code points; texts are cut by position within chunks, as a cut costs the way to it


def find(text: Column, pattern: str, when: Column) -> Column:
    """array<struct<s, e, t, left>>: start, end (exclusive), the match, and the
    last two words of the gap before it; empty where ``when`` does not hold.

    ``when`` is a cheap necessary condition, so that most texts are not cut."""
    cut = f"(?s)(.*?)((?:{pattern})|\\z)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(cut), F.lit(1)).alias("g"),
                         F.regexp_extract_all(text, F.lit(cut), F.lit(2)).alias("h"))
    return F.when(when, _let(pairs, _placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def merged(spans: Column) -> Column:
    """Disjoint array<struct<s, e>> of spans sorted by start: runs of overlapping spans become one
    (spans that only touch stay apart).  A run starts where no earlier span reaches."""
    def with_spans(v):
        def with_reach(reach):
            first = F.filter(F.transform(v, lambda x, i: F.struct(x["s"].alias("s"), reach[i].alias("p"))), lambda x: x["s"] >= x["p"])
            ends = lambda top: _let(first, lambda f: F.transform(f, lambda x, j: F.struct(
                x["s"].alias("s"), F.coalesce(F.get(f, j + 1)["p"], top).alias("e"))))
            return _let(F.array_max(F.transform(v, lambda x: x["e"])), ends)
        return _let(_before(F.transform(v, lambda x: x["e"]), F.greatest, _max), with_reach)

    return F.when(F.size(spans) > 0, _let(spans, with_spans)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def replaced(text: Column, runs: Column, by) -> Column:
    """The text with ``by(run)`` in the place of each of the disjoint runs (s, e), in time linear in the text."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def with_runs(r):
        def with_chunks(c):
            def cut(a, b):
                i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
                many = F.concat(F.substring(F.coalesce(F.get(c, i), F.lit("")), a % CHUNK + 1, F.lit(CHUNK)),
                                F.array_join(F.slice(c, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
                                F.substring(F.coalesce(F.get(c, j), F.lit("")), F.lit(1), b % CHUNK))
                return F.when(i == j, F.substring(F.coalesce(F.get(c, i), F.lit("")), a % CHUNK + 1, b - a)).otherwise(many)

            parts = F.transform(r, lambda x, n: F.concat(cut(F.coalesce(F.get(r, n - 1)["e"], F.lit(0)), x["s"]), by(x)))
            return F.concat(F.array_join(parts, ""), cut(F.element_at(r, -1)["e"], F.length(text)))
        return _let(chunks, with_chunks)
    return F.when(F.size(runs) > 0, _let(runs, with_runs)).otherwise(text)


def mask(text: Column, spans: Column, fill: str = " ") -> Column:
    """The text with ``fill`` in the place of the spans (sorted by start), other positions unchanged."""
    return replaced(text, merged(spans), lambda x: F.repeat(F.lit(fill), x["e"] - x["s"]))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _max(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0))


def _before(values: Column, both, of) -> Column:
    """For each value, ``of`` (a sum or maximum) all values before it: of whole blocks of ``BLOCK``
    values and of the rest of its block, so the work stays near linear."""
    def with_values(v):
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))

        def with_blocks(each):
            def with_offsets(offsets):
                def at(x, i):
                    b = F.floor(i / BLOCK).cast("int")
                    return both(offsets[b], of(F.slice(v, b * BLOCK + 1, i - b * BLOCK)))
                return F.transform(v, at)
            return _let(F.transform(blocks, lambda b: of(F.slice(each, F.lit(1), b))), with_offsets)
        return _let(F.transform(blocks, lambda b: of(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))), with_blocks)
    return _let(values, with_values)


def _last_words(gap: Column) -> Column:
    """The last two words of a text with the white space after them, whole whatever their length."""
    return F.reverse(F.regexp_extract(F.reverse(gap), r"^\s*+(?:\S++)?(?:\s++\S++)?+", 0))


def _placed(pairs: Column) -> Column:
    """Spans of the non-empty matches."""
    def with_starts(starts):
        def place(x, i):
            s = starts[i] + F.length(x["g"])
            return F.struct(s.alias("s"), (s + F.length(x["h"])).alias("e"), x["h"].alias("t"), _last_words(x["g"]).alias("left"))

        return F.filter(F.transform(pairs, place), lambda x: x["t"] != "")
    lengths = F.transform(pairs, lambda x: F.length(x["g"]) + F.length(x["h"]))
    return _let(_before(lengths, lambda a, b: a + b, _sum), with_starts)


def labelled(kinds: list[tuple[str, Column]]) -> Column:
    """One sorted array<struct<s, nth, e, kind, t, left>> from (kind, spans): by start, then kind as listed."""
    def named(n, kind, spans):
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("nth"), x["e"].alias("e"),
                                                     F.lit(kind).alias("kind"), x["t"].alias("t"), x["left"].alias("left")))

    parts = [named(n, kind, spans) for n, (kind, spans) in enumerate(kinds)]
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
