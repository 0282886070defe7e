"""Registered queries of the training-data operators: ``opN_<name>`` applies
operator N to its whole table with the production parameters.

Each query is thin: it reads the table, calls the operator and selects the
columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (conversation_repair, decontaminate, licenses, line_dedup, lm_scoring, minhash_dedup, mixing, oracles,
                            periodic_runs, pii, quality, secrets, spans, token_counts, url_filters)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), tokenizer_path(), limit=4096)


@query("op2_minhash_dedup", oracles.OP2)
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=85)


@query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@query("op4_decontamination", oracles.OP4)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.scan(table(spark, sf_dir, "documents"))
    b = F.col("base")
    return got.select("doc_id", *[spans.count_kind(b, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                      F.sha2(spans.joined(b), 256).alias("base_sha256"),
                      spans.joined(F.array_sort(F.concat("base", "ids"))).alias("spans"))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(table(spark, sf_dir, "documents"))
    b = F.col("base")
    return got.select("doc_id", *[spans.count_kind(b, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                      F.sha2(spans.joined(b), 256).alias("base_sha256"),
                      spans.joined(F.array_sort(F.concat("base", "linked"))).alias("spans"))


@query("op7_mixing", oracles.OP7)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"), share=1.5, max_copies=2)
    return got.select("doc_id", "size", "source_size", "target", "taken", "copies")


#: Fixed by the contract: (verdict, host and path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op8_url_filters", oracles.OP8)
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    got = url_filters.judge(table(spark, sf_dir, "pages"), outcomes, url_filters.rules_table(spark, URL_RULES))
    return got.select("page_id", "host", "path", "rule", "verdict")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "n_covered", "longest_repeat",
                      F.size("repeats").alias("n_repeats"))


@query("op10_license_scan", oracles.OP10)
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "digest", "license", F.size("named").cast("long").alias("n_named"),
                      F.array_join("named", ",").alias("named"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = periodic_runs.planted(F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")))
    got = docs.select("doc_id", periodic_runs.find_runs(text).alias("r")).select("doc_id", "r.runs", "r.collapsed")
    top = F.col("top")
    return got.withColumn("top", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"), F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periodic_runs.runs_text(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, lost=F.col("lost")).report


@query("op13_line_dedup", oracles.OP13)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
