"""Token counts with a whole-token shortcut.

A text's pre-tokens are runs of spaces with the word that follows, words after
a line break, and line breaks.  Before any text is read, each worker proves
from the vocabulary alone that

* no piece spans a pre-token boundary (so the merges of a text are those of
  its pre-tokens, each on its own), and
* which vocabulary strings, taken as pre-tokens, encode as exactly one token.

A pre-token among these counts as one without being merged; only the rest goes
through the library, and its count is remembered up to ``CACHE_PRETOKENS`` entries.
Null and empty texts have no token; the counts are per row, so repeated ids or rows each get their own.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
PRETOKEN = re.compile(rf"[ {SPACE}]+[^ {SPACE}\n]*|\n|[^ {SPACE}\n]+")
CACHE_PRETOKENS = 200_000
CACHE_CHARS = 64
LONG_TEXT = 1 << 20     # longer texts are walked, not cut into a list


class PieceCounter(dict):
    """Pre-token -> number of tokens; whole-token strings are filled in ahead."""

    def __init__(self, model_path: str):
        import sentencepiece
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        m = self.model
        special = {i for i in range(m.get_piece_size()) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i)}
        pieces = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if i not in special}
        self._prove_boundaries(pieces)
        self.whole = frozenset(self._whole_tokens(pieces))
        self._refill()

    def _prove_boundaries(self, pieces) -> None:
        probe = "  a  b \n\tÀ　 "
        if self.model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model must escape spaces, add one in front and keep the rest as it is")
        for p in pieces:
            if len(PRETOKEN.findall(p)) != 1:
                raise ValueError(f"piece {p!r} spans a pre-token boundary")

    def _whole_tokens(self, pieces) -> Iterator[str]:
        for p, i in pieces.items():
            if self._ids(p) == [i]:
                yield p
                yield p.replace(SPACE, " ")

    def _ids(self, pretoken: str) -> list[int]:
        """Ids of a pre-token standing inside a text: the library's own leading
        space is the pre-token's first one, or is cut off with a line break."""
        if pretoken[0] in f" {SPACE}":
            return self.model.encode(pretoken[1:]) if len(pretoken) > 1 else self._after_break(pretoken)
        return self._after_break(pretoken)

    def _after_break(self, pretoken: str) -> list[int]:
        return self.model.encode("\n" + pretoken)[len(self.model.encode("\n")):]

    def _refill(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.whole, 1))

    def __missing__(self, pretoken: str) -> int:
        n = len(self._ids(pretoken))
        if len(pretoken) <= CACHE_CHARS:
            if len(self) >= CACHE_PRETOKENS + len(self.whole):
                self._refill()
            self[pretoken] = n
        return n

    def count(self, text: str | None) -> tuple[int, int]:
        """(tokens, pre-tokens taken whole) of a text."""
        if not text:
            return 0, 0
        whole, cost = self.whole, self.__getitem__
        if len(text) > LONG_TEXT:
            n = direct = 0
            for m in PRETOKEN.finditer(" " + text):
                n += cost(m[0])
                direct += m[0] in whole
            return n, direct
        parts = PRETOKEN.findall(" " + text)
        return sum(map(cost, parts)), sum(map(whole.__contains__, parts))


@functools.lru_cache(maxsize=4)
def counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def token_counts(text: Column, model_path: str) -> Column:
    """struct<n_tokens, n_whole>: tokens of the text, and how many of them
    were pre-tokens counted directly."""

    @F.arrow_udf("struct<n_tokens:bigint,n_whole:bigint>")
    def count(texts: pa.Array) -> pa.Array:
        c = counter(model_path)
        got = [c.count(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())],
            ["n_tokens", "n_whole"])

    return count(text)


def count_documents(docs: DataFrame, model_path: str, limit: int = 4096,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, n_whole.

    Other input columns are not read, whatever their names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"),
                    token_counts(text, model_path).alias("t"))
    return t.select(id_col, "n_bytes", F.col("t.n_tokens").alias("n_tokens"),
                    (F.col("t.n_tokens") > limit).alias("over_limit"), F.col("t.n_whole").alias("n_whole"))
