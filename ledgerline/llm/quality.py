"""Quality rules from repeated passages, found with suffix arrays over words.

For a batch of texts one suffix array is built by prefix doubling over word
ranks (a word's rank includes its text, so suffixes of different texts never
match); only suffixes that still tie are sorted again.  Longest common
prefixes of neighbours come from the stored ranks; runs of neighbours that
share at least m words are the LCP intervals, and the union of their spans
is what the text repeats.

Defined results: null and empty texts have no words, fail the base rule
(fewer than 20 words) and are not kept; results are per row, so repeated rows
each get their own; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import words as W

MIN_WORDS = 20              # base rule
BASE_WINDOW = 8             # words in a repeated window of the base rule
BASE_REPEAT_PERCENT = 30
MIN_REPEAT = 5              # shortest repeat, in words, whose span counts
MAX_COVERED = 0.40          # limit on the fraction of words inside repeats
MAX_LONGEST = 0.25          # limit on the longest repeat, as a fraction of the words ...
LONGEST_FLOOR = 50          # ... and at least so many words

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, dtype=bool)        # not a UTF-8 continuation byte
_LEAD[0x80:0xC0] = False
_WORD_LEAD = _LEAD & W.SPACED_RAW.keep

FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
          ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_covered", pa.int64()),
          ("longest_repeat", pa.int64()),
          ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
DDL = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
       "n_covered:bigint,longest_repeat:bigint,repeats:array<struct<start:bigint,end:bigint>>>")


def suffix_array(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP with the suffix before) of the texts in ``doc``."""
    n = len(symbols)
    end = np.searchsorted(doc, doc, side="right")           # doc is sorted
    key = W.mix(symbols + W.random_words(21, 1)[0] * doc.astype(W.U64))
    at = np.arange(n)

    def first_of(new):
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = first_of(new)
    levels = [rank.copy()]
    last = np.concatenate((new[1:], [True]))
    active = order[~(new & last)]
    step = 1
    while len(active):
        nxt = active + step
        second = np.where(nxt < end[active], rank[np.minimum(nxt, n - 1)], -1)
        old = rank[active]
        o = np.lexsort((second, old))
        a, old, second = active[o], old[o], second[o]
        fresh_old = np.concatenate(([True], old[1:] != old[:-1]))
        fresh = fresh_old | np.concatenate(([True], second[1:] != second[:-1]))
        rank[a] = old + first_of(fresh) - first_of(fresh_old)
        levels.append(rank.copy())
        last = np.concatenate((fresh[1:], [True]))
        active = a[~(fresh & last)]
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = at
    lcp = np.zeros(n, np.int64)
    todo = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1     # neighbours that share a word
    p, q = sa[todo - 1], sa[todo]
    got = np.zeros(len(todo), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        i1, i2 = p + got, q + got
        same = (i1 < end[p]) & (i2 < end[q])
        same &= levels[j][np.minimum(i1, n - 1)] == levels[j][np.minimum(i2, n - 1)]
        got += same * (1 << j)
    lcp[todo] = got
    return sa, lcp


def repeat_lengths(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word: length of the longest passage that starts there and
    occurs elsewhere in the same text too."""
    sa, lcp = suffix_array(symbols, doc)
    best = np.empty(len(sa), np.int64)
    best[sa] = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
    return best


def measure(texts: pa.Array, min_repeat: int = MIN_REPEAT, window: int = BASE_WINDOW) -> pa.Array:
    parts = [_measure(d, o, min_repeat, window) for d, o, _, _ in W.chunks(texts)]
    if not parts:
        return pa.array([], pa.struct(FIELDS))
    return pa.concat_arrays(parts)


def _measure(data: np.ndarray, off: np.ndarray, min_repeat: int, window: int) -> pa.Array:
    n_docs = len(off) - 1
    w = W.split(data, off, W.SPACED_RAW)
    n = len(w.hashes)
    doc = w.doc
    zeros = np.zeros(n_docs, np.int64)
    repeat_words, n_covered, longest = zeros, zeros, zeros
    spans: list[list] = [[] for _ in range(n_docs)]
    if n:
        best = repeat_lengths(w.hashes, doc)
        at = np.flatnonzero(best >= window)
        repeat_words = W.per_text(W.covered(n, at, window), w.first)
        at = np.flatnonzero(best >= min_repeat)
        inside = W.covered(n, at, best[at])
        n_covered = W.per_text(inside, w.first)
        has = np.flatnonzero(w.counts)
        longest = zeros.copy()
        longest[has] = np.maximum.reduceat(best, w.first[:-1][has])
        edge = inside & ~np.concatenate(([False], inside[:-1] & (doc[1:] == doc[:-1])))
        stop = inside & ~np.concatenate((inside[1:] & (doc[1:] == doc[:-1]), [False]))
        for s, e in zip(np.flatnonzero(edge).tolist(), np.flatnonzero(stop).tolist()):
            d = int(doc[s])
            base = int(w.first[d])
            spans[d].append({"start": s - base, "end": e + 1 - base})
    lines = W.split(data, off, W.LINES)
    dup = zeros
    if len(lines.hashes):
        worded = np.logical_or.reduceat(W.SPACED_RAW.keep[data], lines.starts)
        h, d = lines.hashes[worded], lines.doc[worded]
        o = np.lexsort((h, d))
        h, d = h[o], d[o]
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (d[1:] == d[:-1])))[: len(h)]
        dup = np.bincount(d[again], minlength=n_docs).astype(np.int64)
    cols = [w.counts, W.per_text(_WORD_LEAD[data], off), W.per_text(_SYMBOL[data], off), dup, repeat_words,
            n_covered, longest]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array(spans, FIELDS[-1][1])],
                                      [f[0] for f in FIELDS])


def repetition(text: Column, min_repeat: int = MIN_REPEAT, window: int = BASE_WINDOW) -> Column:
    """struct of the measures above; ``repeats`` holds the united spans (in words)."""

    @F.arrow_udf(DDL)
    def measured(texts: pa.Array) -> pa.Array:
        return measure(texts, min_repeat, window)

    return measured(text)


def base_failed(m: Column) -> Column:
    return ((m["n_words"] < MIN_WORDS)
            | (100 * m["n_repeat_words"] > BASE_REPEAT_PERCENT * m["n_words"]))


def passes(m: Column, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST,
           longest_floor: int = LONGEST_FLOOR) -> Column:
    """Kept: the base rule holds, repeats cover at most ``max_covered`` of the
    words, and the longest repeat is within its limit."""
    longest_ok = ((m["longest_repeat"] <= longest_floor)
                  | (m["longest_repeat"] <= max_longest * m["n_words"]))
    return ~base_failed(m) & (m["n_covered"] <= max_covered * m["n_words"]) & longest_ok


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the measures, base_failed, kept."""
    t = docs.select(F.col(id_col), repetition(F.col(text_col)).alias("m"))
    m = F.col("m")
    return t.select(id_col, "m.*", base_failed(m).alias("base_failed"), passes(m).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows, all columns, without those the rules reject."""
    row = docs.select(F.struct("*").alias("row"), repetition(F.col(text_col)).alias("m"))
    return row.where(passes(F.col("m"))).select("row.*")
