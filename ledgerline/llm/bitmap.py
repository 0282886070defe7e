"""A bitmap of keys: drops rows that can't match before they are shuffled.

The bitmap has a fixed size (``2 ** log2_bits`` bits, 2 MB at the default 24)
whatever the number of keys; a key sets one bit.  With more keys it lets more
rows through, up to all of them, and the exact join behind it still
decides, so it never loses a match and never grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import words as W

LOG2_BITS = 24


def positions(keys: np.ndarray, log2_bits: int) -> np.ndarray:
    return (W.mix(keys.astype(W.U64)) >> W.U64(64 - log2_bits)).astype(np.int64)


class Bitmap:
    """Broadcast bitmap of the 64-bit keys in ``keys[col]`` (nulls left out)."""

    def __init__(self, keys: DataFrame, col: str, log2_bits: int = LOG2_BITS):
        spark = keys.sparkSession
        self.log2_bits = log2_bits

        @F.arrow_udf("bigint")
        def bit(k: pa.Array) -> pa.Array:
            return pa.array(positions(k.to_numpy(zero_copy_only=False), log2_bits), pa.int64())

        at = keys.where(F.col(col).isNotNull()).select(bit(F.col(col).cast("long")).alias("at"))
        # at most 2 ** (log2_bits - 6) rows come to the driver: one 64-bit word of the bitmap each
        filled = at.groupBy(F.shiftright("at", 6).alias("i")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("w")).toPandas()
        table = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
        table[filled["i"].to_numpy(np.int64)] = filled["w"].to_numpy(np.int64).astype(np.uint64)
        self.table = spark.sparkContext.broadcast(table)

    def might_have(self, col: Column) -> Column:
        """False only where the key is surely not in the bitmap (null: false)."""
        table, log2_bits = self.table, self.log2_bits

        @F.arrow_udf("boolean")
        def test(k: pa.Array) -> pa.Array:
            known = np.asarray(k.is_valid())
            got = k.fill_null(0).to_numpy(zero_copy_only=False)
            return pa.array(known & lookup(table.value, got, log2_bits), pa.bool_())

        return test(col.cast("long"))


def lookup(table: np.ndarray, keys: np.ndarray, log2_bits: int) -> np.ndarray:
    at = positions(keys, log2_bits)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == np.uint64(1)
