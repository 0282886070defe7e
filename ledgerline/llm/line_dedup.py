"""Line dedup: lines that many documents share stay in one document only.

A line's key is the line without white space at its ends and with A-Z
lower-cased, as a 128-bit digest.  Keys are exploded (one per document), counted in two steps, and the lines of
frequent keys are dropped everywhere but in the largest id holding them; the kept lines are joined again by position:

1. occurrences per first half of the digest (8 bytes a row, summed before the
   shuffle) leave the halves that enough rows share;
2. the occurrences with such a half are joined back, and distinct documents and the largest id are
   counted per whole digest (by document first, so that no line is gathered in one task);
3. each document gets the digests it loses, and its lines are filtered in order.

Keys that more than one in ``HOT_SHARE`` occurrences have are at most ``HOT_SHARE`` many; they are joined by broadcast, so
a line that a third of all documents share is never dealt to one task.  All other joins are on evenly spread keys.

Defined results: a null or empty text is one empty line; a null id is a document that is smaller
than all others; rows that repeat an id are one document when lines are counted, and lose the same lines each; a
line that occurs twice in one document counts once and is dropped or kept in both places.  Only the
id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ledgerline.session import checkpoint_dir

MIN_CHARS = 40          # code points of a key that is counted
MIN_DOCUMENTS = 5       # documents that make a key frequent
HOT_SHARE = 1000        # a key of more than 1/HOT_SHARE of all occurrences is joined by broadcast

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LEADS = bytes(c for c in range(0x80, 0xC0))       # UTF-8 continuation bytes


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The digest of the line's key, None if the key is shorter than ``min_chars`` code points."""
    key = line.strip(SPACE)
    if len(key) < min_chars or len(key.translate(None, _LEADS)) < min_chars:
        return None
    return xxh3_128_digest(key.translate(_LOWER))


def _keys(text: Column, min_chars: int) -> Column:
    """Distinct line keys of each text, as two 64-bit halves."""
    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def keys(texts: pa.Array) -> pa.Array:
        off, found = [0], []
        for t in texts.cast(pa.large_binary()).to_pylist():
            mine = {line_key(x, min_chars) for x in (t or b"").split(b"\n")} - {None}
            found.extend(sorted(mine))
            off.append(len(found))
        flat = pa.Array.from_buffers(pa.int64(), 2 * len(found), [None, pa.py_buffer(b"".join(found))])
        at = pa.array(range(0, 2 * len(found), 2), pa.int64())
        halves = pa.StructArray.from_arrays([flat.take(at), flat.take(pa.compute.add(at, 1))], ["a", "b"])
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), halves)

    return keys(text)


def _rejoined(text: Column, lost: Column, min_chars: int) -> Column:
    """struct<n_lines, n_dropped, kept>: the text's lines in order without those whose key is in ``lost``."""
    @F.arrow_udf("struct<n_lines:bigint,n_dropped:bigint,kept:string>")
    def rejoined(texts: pa.Array, losts: pa.Array) -> pa.Array:
        n_lines, n_dropped, kept = [], [], []
        for t, gone in zip(texts.cast(pa.large_binary()), losts):
            lines = (t.as_py() or b"").split(b"\n")
            rest = lines
            if gone.is_valid:
                keys = {x["a"].to_bytes(8, "little", signed=True) + x["b"].to_bytes(8, "little", signed=True)
                        for x in gone.as_py()}
                rest = [x for x in lines if line_key(x, min_chars) not in keys]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(rest))
            kept.append(b"\n".join(rest))
        return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                           pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
                                          ["n_lines", "n_dropped", "kept"])

    return rejoined(text, lost)


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/line-dedup-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _with(occurrences: DataFrame, found: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join with one row per key; ``rows`` holds the key's occurrences.

    At most ``HOT_SHARE`` keys have more than total / HOT_SHARE of them: those are broadcast, the others shuffled."""
    is_hot = F.col(rows) * HOT_SHARE > total
    hot, rest = found.where(is_hot), found.where(~is_hot)
    mine = reduce(lambda x, y: x & y, [F.col(f"h.{c}") == F.col(f"o.{c}") for c in on])
    cold = occurrences.alias("o").join(F.broadcast(hot.alias("h")), mine, "left_anti")
    return occurrences.join(F.broadcast(hot), on).unionByName(cold.join(rest, on))


def frequent_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_documents: int) -> DataFrame:
    """(id, lost): the keys whose lines each document loses; only documents that lose any."""
    occurrences = _written(docs.select(F.col(id_col).alias("id"), F.explode(_keys(F.col(text_col), min_chars)).alias("k"))
                           .select("id", "k.a", "k.b"), "occurrences")
    total = occurrences.count()
    often = _written(occurrences.groupBy("a").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_documents), "often")
    hits = _written(_with(occurrences, often, ["a"], "rows", total).select("id", "a", "b").distinct(), "hits")
    # a null id is counted apart: countDistinct and max leave it out
    shared = hits.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_documents)
    lost = _with(hits, _written(shared, "shared"), ["a", "b"], "n", total).where(F.col("id").isNull() | (F.col("id") < F.col("last")))
    return lost.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("lost"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(id, n_lines, n_dropped, kept) per row: number of lines, lines dropped, and the text that stays."""
    lost = frequent_lines(docs, id_col, text_col, min_chars, min_documents)
    d, x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("d"), lost.alias("x")
    r = _rejoined(F.col("d.text"), F.col("x.lost"), min_chars)
    return (d.join(x.hint("shuffle_hash"), F.col("d.id").eqNullSafe(F.col("x.id")), "left")
             .select(F.col("d.id").alias(id_col), r.alias("r")).select(id_col, "r.*"))
