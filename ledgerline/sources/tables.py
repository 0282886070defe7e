"""Scans of the base Parquet tables.

Plain ``spark.read.parquet``: Catalyst prunes columns and pushes filters into
the scan, so callers just select what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_SCANS: dict[tuple, DataFrame] = {}


def session_key(spark: SparkSession) -> tuple:
    """Identity of a live session: a new application never reuses cached
    DataFrames of a stopped one."""
    return id(spark), spark.sparkContext.applicationId


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a DataFrame; the scan object is reused per session and
    path, so file listing and footer reads happen once per plan build."""
    key = (session_key(spark), table_path(sf_dir, name))
    df = _SCANS.get(key)
    if df is None:
        df = spark.read.parquet(table_path(sf_dir, name))
        _SCANS[key] = df
    return df
