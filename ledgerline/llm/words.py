"""Words of a batch of texts as 64-bit fingerprints (numpy over the Arrow buffer).

The Python operators work on whole Arrow batches: a batch's texts lie one
after the other in one byte buffer, words are found with byte masks, and each
word becomes a 64-bit fingerprint of its bytes, so no Python object is made per word.
Large batches are cut between texts into chunks, which bounds the temporaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_POWERS = 1 << 16       # words over 64 KiB reuse the powers from the start

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (multiply and xor-shift)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)))


def _powers(seed: int, n: int) -> np.ndarray:
    base = random_words(seed, 1)[0] | U64(1)
    return np.multiply.accumulate(np.full(n, base, dtype=U64))


_POW = _powers(11, _POWERS)
_SEQ = random_words(12, 64) | U64(1)


class ByteClass:
    """Which bytes form words, and the number each word byte stands for."""

    def __init__(self, separators: bytes, fold: bool, seed: int = 7):
        self.value = random_words(seed, 256)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.keep = np.ones(256, dtype=bool)
        self.keep[list(separators)] = False
        self.value[~self.keep] = 0


_ASCII_SPACE = bytes([9, 10, 11, 12, 13, 32])
SPACED = ByteClass(_ASCII_SPACE, fold=True)         # lower-cased A-Z, [^\x20\x09-\x0D]+
SPACED_RAW = ByteClass(_ASCII_SPACE, fold=False)
LINES = ByteClass(b"\n", fold=False)
ALNUM = ByteClass(bytes(b for b in range(128) if not chr(b).isalnum()), fold=True)   # [0-9A-Za-z] and non-ASCII


@dataclass
class Words:
    hashes: np.ndarray      # uint64 per word
    first: np.ndarray       # first word of each text, and the number of words at the end
    starts: np.ndarray      # byte position of each word in the chunk

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kinds = texts.buffers()
    if len(texts) == 0 or kinds[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(kinds[1], dtype=np.int64 if wide else np.int32)
    off = off[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(kinds[2], dtype=np.uint8)[off[0]: off[-1]], off - off[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, from, to) for consecutive texts of about ``limit`` bytes together."""
    data, off = buffer(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield data[off[i]: off[j]], off[i: j + 1] - off[i], i, j
        i = j


def split(data: np.ndarray, off: np.ndarray, of: ByteClass) -> Words:
    n = len(data)
    keep = of.keep[data]
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    at = off[:-1][off[:-1] < n]
    begin[at] = keep[at]                    # a text's first byte never continues the text before
    starts = np.flatnonzero(begin)
    if len(starts) == 0:
        return Words(np.zeros(0, U64), np.zeros(len(off), np.int64), starts)
    word = np.cumsum(begin, dtype=np.int32)
    word -= 1
    rel = np.arange(n, dtype=np.int64)
    rel -= starts[word]                     # before the first word: index -1, and the byte's value is 0
    rel &= _POWERS - 1
    value = of.value[data]
    value *= _POW[rel]
    hashes = mix(np.add.reduceat(value, starts))
    return Words(hashes, np.searchsorted(starts, off).astype(np.int64), starts)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, text, first word) of every run of ``k`` words inside a
    text; a text of fewer words, but not none, gives its whole sequence."""
    h, n = w.hashes, len(w.hashes)
    counts = w.counts
    if n >= k:
        value = np.zeros(n - k + 1, dtype=U64)
        for j in range(k):
            value += h[j: n - k + 1 + j] * _SEQ[j]
        doc = w.doc
        inside = doc[: n - k + 1] == doc[k - 1:]
        pos = np.flatnonzero(inside)
        out, of = mix(value[pos] + U64(k)), doc[pos]
    else:
        pos = np.zeros(0, np.int64)
        out, of = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = w.first[:-1][short]
        value = np.zeros(len(short), dtype=U64)
        for j in range(k - 1):
            has = counts[short] > j
            value[has] += h[first[has] + j] * _SEQ[j]
        value = mix(value + counts[short].astype(U64))
        at = np.searchsorted(of, short)
        out, of, pos = np.insert(out, at, value), np.insert(of, at, short), np.insert(pos, at, first)
    return out, of, pos


def covered(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Mask over ``n`` positions: inside any of the spans [start, start + length)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive bounds of ``first``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]
