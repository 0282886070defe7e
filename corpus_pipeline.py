"""The corpus pipeline: filters, near-dedup, decontamination, secrets, mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; stages are
written as Parquet in the shared folder and read again, so a lost executor
costs at most the stage at work.  All but the last return the columns of ``docs``:

1. quality rules: rejected documents go;
2. min-max near-dedup: one document of each group of near duplicates (similarity from 0.8) stays;
3. benchmark decontamination: contaminated documents go;
4. secret scans: findings are replaced in the text, the document stays;
5. mixing: documents taken, with ``copies``, the source's target and the words taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, minhash_dedup, mixing, quality, secrets
from ledgerline.llm.queries import table
from ledgerline.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mixed(docs, share=1.5, max_copies=2)
    # the mix's own columns come last and win over equal names
    return taken.select("row.*", "copies") if "copies" not in docs.columns else taken.select(
        F.col("row").dropFields("copies").alias("row"), "copies").select("row.*", "copies")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
]

#: Min-hash links and redaction by position are not expressed in SQL; tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{n}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
