"""Runs of periodic words in texts, found with multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at
least ``max(6, 4q)`` words that no neighbouring word extends.  Each Arrow batch is searched with numpy, chunk by chunk:

* periods up to ``SHORT``: direct lag scans, one comparison of the words with themselves q places on;
* longer periods, one scale per power of two: for q in (m/2, m] the minimizers are the least
  fingerprints of m words over windows of m/2 places.  All windows inside a run come again q places
  on with the same minimizers, and no m words of a run come again sooner (m >= q), so neighbouring places with
  equal minimizers are exactly q apart somewhere in the run.  A pair is already a stretch of
  period q over q + m words; it is extended word by word, once per run.

Windows, their minima and the places that a window selects are running minima and maxima over
powers of two, so a text of n words costs O(n log^2 n) time and some ten arrays of n numbers: a text of 40 MB
needs about 0.7 GB in its Python worker, whatever it repeats.

Defined results: null and empty texts have no words and no runs; results are per row, so repeated
rows each get their own; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.llm import words as W

SHORT = 16              # periods up to this one are scanned directly; a power of two
LEAST_WORDS = 6
LEAST_PERIODS = 4

_STEP = W.random_words(31, 64) | W.U64(1)
_BLOCK = 64             # first stretch that an extension compares; doubled as long as it holds


def _least(q: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * q)


def _prime_factors(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] * (q > 1)


def _smallest(w: np.ndarray, start: int, q: int) -> bool:
    """Whether a stretch of period q, at least 2q long, has no smaller period: it would divide q."""
    return not any(np.array_equal(w[start: start + q], w[start + q // r: start + q // r + q]) for r in _prime_factors(q))


def _short(w: np.ndarray, longest: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, q) for q up to ``SHORT`` by lag scans."""
    for q in range(1, min(SHORT, longest // LEAST_PERIODS) + 1):
        same = np.zeros(len(w) - q + 2, np.int8)
        same[1:-1] = w[q:] == w[:-q]
        edge = np.diff(same)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for i in np.flatnonzero(stop - start + q >= _least(q)).tolist():
            if _smallest(w, int(start[i]), q):
                yield int(start[i]), int(stop[i] - start[i]) + q, q


def _running(x: np.ndarray, width: int, pick, pad) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``width`` places from each place on; ``width`` is a power of two."""
    step = 1
    while step < width:
        ahead = np.full_like(x, pad)
        ahead[:-step] = x[step:]
        x = pick(x, ahead)
        step *= 2
    return x


def _selected(h: np.ndarray, width: int) -> np.ndarray:
    """Places whose fingerprint is the least of some window of ``width`` places, ties included."""
    low = _running(h, width, np.minimum, W.U64(2**64 - 1))
    reached = _running(low[::-1], width, np.maximum, W.U64(0))[::-1]
    return np.flatnonzero(reached == h)


def _extent(w: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """[from, to) of the places x around ``at`` with w[x] == w[x + q]."""
    hi, size, n = at, _BLOCK, len(w) - q
    while hi < n:
        same = w[hi: min(hi + size, n)] == w[hi + q: min(hi + size, n) + q]
        if not same.all():
            hi += int(np.argmin(same))
            break
        hi, size = hi + len(same), size * 2
    lo, size = at, _BLOCK
    while lo > 0:
        same = (w[max(lo - size, 0): lo] == w[max(lo - size, 0) + q: lo + q])[::-1]
        if not same.all():
            lo -= int(np.argmin(same))
            break
        lo, size = lo - len(same), size * 2
    return lo, hi


def _long(w: np.ndarray, longest: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, q) for q over ``SHORT`` by minimizers of each scale."""
    h, m, level = w, 1, 0
    while LEAST_PERIODS * (m // 2 + 1) <= longest or m <= SHORT:
        if m > SHORT:
            at = _selected(h, m // 2)
            order = np.argsort(h[at], kind="stable")
            at = at[order]
            gap = np.diff(at)
            ok = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (gap > m // 2) & (gap <= m))
            seeds, gaps = at[ok], gap[ok]
            order = np.lexsort((seeds, gaps))
            last = (0, -1)                       # the gap and the end of the run extended last
            for x, q in zip(seeds[order].tolist(), gaps[order].tolist()):
                if last[0] == q and x < last[1]:
                    continue
                lo, hi = _extent(w, x, q)
                last = (q, hi)
                if hi - lo + q >= _least(q) and _smallest(w, lo, q):
                    yield lo, hi - lo + q, q
        if 2 * m > len(w):
            break
        ahead = np.zeros_like(h)
        ahead[:-m] = h[m:]
        h = W.mix(h * _STEP[level] + ahead)
        m, level = 2 * m, level + 1


def runs_of(symbols: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period; ``symbols`` are the words'
    fingerprints, ``doc`` (ascending) their text."""
    if not len(symbols):
        return []
    # other texts' words never match, and neither do k words that reach into the next text
    w = W.mix(symbols + _STEP[63] * doc.astype(W.U64))
    longest = int(np.bincount(doc - doc[0]).max())
    return sorted({*_short(w, longest), *_long(w, longest)}, key=lambda r: (r[0], r[2]))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
DDL = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def _measured(texts: pa.Array) -> pa.Array:
    n_words, off, spans, collapsed = [], [0], [], []
    for data, bounds, i, j in W.chunks(texts):
        words = W.split(data, bounds, W.SPACED_RAW)
        found = runs_of(words.hashes, words.doc)
        first = words.first.tolist()
        at = 0
        for d in range(j - i):
            text, mine = data[bounds[d]: bounds[d + 1]].tobytes().split(), []
            while at < len(found) and found[at][0] < first[d + 1]:
                mine.append((found[at][0] - first[d], *found[at][1:]))
                at += 1
            if mine:
                drop = W.covered(len(text), np.array([s + q for s, _, q in mine]), np.array([n - q for _, n, q in mine]))
                text_kept = [x for x, gone in zip(text, drop.tolist()) if not gone]
            else:
                text_kept = text
            n_words.append(len(text))
            spans += mine
            off.append(len(spans))
            collapsed.append(b" ".join(text_kept))
    flat = np.array(spans, np.int64).reshape(-1, 3)
    runs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(RUN))
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), runs),
         pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])


def find_runs(text: Column) -> Column:
    """struct<n_words, runs, collapsed>: all runs by start, then period (word numbers from 0),
    and the text's words without those that repeat a run's first period, joined by one space."""

    @F.arrow_udf(DDL)
    def runs(texts: pa.Array) -> pa.Array:
        return _measured(texts)

    return runs(text)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period (ties: smallest start, then period); null without runs."""
    def step(best, x):
        # length / period compared exactly, as products
        more = x["length"] * best["period"] > best["length"] * x["period"]
        return F.when(best.isNull() | more, x).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), step)


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line feed per run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def planted(text: Column, seed: Column) -> Column:
    """The text, in which every tenth ``seed`` makes the words from one place on repeat a period
    (the cases of op11); a null seed changes nothing."""

    @F.arrow_udf("string")
    def plant(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        out = []
        for t, h in zip(texts, seeds.to_pylist()):
            t = t.as_py()
            words = t.encode().split() if t and h is not None and h % 10 == 0 else []
            if words:
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                piece = words[a: a + p]
                whole, rest = divmod(n - a, p)
                t = b" ".join(words[:a] + piece * whole + piece[:rest]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    return plant(text, seed)
