"""Staged tables: derived inputs written once to the shared folder and read
back as files.

Reports in production read stored tables (the upserted order lines, the
stock table, landed feed files), not the lineage that produced them.  The
fixture views and feeds are staged the same way: computed by Spark from the
driver tables, written under ``<spark.checkpoint.dir>/ledgerline-staged``
(the shared folder named by the cluster), and read back with the normal
readers, so later plans are small and get Parquet pushdown and pruning.

The location is keyed by the view name, the code that builds it, and the paths,
sizes and modification times of all input files (nested ones too); a stale copy is never reused.  A copy is
used only when its completion marker exists, so a write interrupted by a
lost executor or driver is simply redone.  Writers never overwrite a
published copy: each writes to its own temporary folder and renames it into
place, so concurrent jobs never read a half-replaced table.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import checkpoint_dir



@functools.cache
def _code() -> str:
    """Hash of the modules that build staged tables: changed code, new copies."""
    root = Path(__file__).resolve().parents[1]
    names = ("sources/fixtures.py", "sources/feeds.py", "functions/rules.py", "sinks/tables.py",
             "sinks/order_table.py")
    return hashlib.sha1(b"".join((root / n).read_bytes() for n in names)).hexdigest()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _fingerprint(spark: SparkSession, inputs: Sequence[str]) -> str:
    parts = []
    for path in sorted(inputs):
        fs, p, _ = _fs(spark, path)
        try:
            files = fs.listFiles(p, True)       # nested files too
            while files.hasNext():
                st = files.next()
                parts.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
        except Exception:  # missing input: let the read fail later with a clear error
            parts.append(f"{path}:missing")
    return "|".join(parts)


MARKER = "_STAGED"


def _done(spark: SparkSession, path: str) -> bool:
    fs, _, jvm = _fs(spark, path)
    return bool(fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKER}")))


def staged(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame] | None = None,
           read: Callable[[str], DataFrame] | None = None, fmt: str = "parquet",
           partition_by: Sequence[str] = (), write: Callable[[str], None] | None = None) -> DataFrame:
    """Return ``build()`` staged as files (written on first use); ``write``
    stands in for the plain writer where a sink writes the table."""
    key = hashlib.sha1(f"{_code()}|{name}|{_fingerprint(spark, inputs)}".encode()).hexdigest()[:16]
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgerline-staged/{name}-{key}"
    if not _done(spark, path):
        tmp = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
        if write:
            write(tmp)
        else:
            w = build().write.mode("overwrite").option("partitionOverwriteMode", "static").format(fmt)
            if partition_by:
                w = w.partitionBy(*partition_by)
            w.save(tmp)
        fs, target, jvm = _fs(spark, path)
        src = jvm.org.apache.hadoop.fs.Path(tmp)
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{tmp}/{MARKER}"), True).close()   # complete copy
        if _done(spark, path):          # another writer published first
            fs.delete(src, True)
        else:
            if fs.exists(target):       # leftover of an interrupted publish
                fs.delete(target, True)
            if not fs.rename(src, target) and not _done(spark, path):
                raise RuntimeError(f"could not publish staged table {path}")
            if fs.exists(src):
                fs.delete(src, True)
    return read(path) if read else spark.read.format(fmt).load(path)
