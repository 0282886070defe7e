"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (partial before the shuffle) and an equi-join
against one row per node, so a node with very many links is never gathered in
one task; the number of steps grows with the logarithm of the longest chain.
Steps are cut with ``checkpoint()`` in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import checkpoint_dir


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def _print(e: DataFrame) -> tuple:
    """(rows, order-free fingerprint) of the links."""
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id with a link to another: the smallest id reachable."""
    checkpoint_dir(links.sparkSession)
    e = _pairs(links.select(F.col(a).alias("u"), F.col(b).alias("v"))).checkpoint()
    seen = _print(e)
    while seen[0]:
        e = _pairs(_small_star(_pairs(_large_star(e)))).checkpoint()
        now = _print(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
