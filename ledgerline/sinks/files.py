"""Files and folders of stored tables, through the Hadoop file system of their path."""

from __future__ import annotations

import functools
import json
from urllib.parse import unquote

from pyspark.sql import SparkSession


@functools.lru_cache(maxsize=1)
def _gateway(sc):
    """(Path class, Hadoop settings): looked up once, as each step of the lookup is a call to the JVM."""
    return sc._jvm.org.apache.hadoop.fs.Path, sc._jsc.hadoopConfiguration()


def _fs(spark: SparkSession, path: str):
    path_class, conf = _gateway(spark.sparkContext)
    p = path_class(path)
    return p.getFileSystem(conf), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; empty where there is none."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename to a place that is free; the parent folder is made."""
    fs, p = _fs(spark, source)
    _, q = _fs(spark, target)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise RuntimeError(f"could not rename {source} to {target}")


def file_count(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getFileCount() if fs.exists(p) else 0


def total_size(spark: SparkSession, path: str) -> int:
    """Bytes of a folder's files, nested ones too."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small file that is there as a whole or not at all: written aside, then renamed."""
    aside = f"{path}.tmp"
    write_text(spark, aside, json.dumps(value))
    move(spark, aside, path)


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def partitions(spark: SparkSession, path: str, depth: int) -> dict[tuple[str, ...], str]:
    """{partition values: relative folder} of ``name=value`` folders ``depth`` levels deep."""
    found = {(): ""}
    for _ in range(depth):
        found = {(*v, unquote(n.split("=", 1)[1])): f"{d}/{n}".lstrip("/") for v, d in found.items()
                 for n in names(spark, f"{path}/{d}") if "=" in n and not n.startswith(".")}
    return found
