"""License scans by canonical digest lookup (DataFrame functions only).

A text is brought to a canonical form -- lower case, copyright lines left out,
equivalent spellings written one way, everything but letters and digits as
single spaces -- and its digest is joined with the digests of known licences, computed by the
same expressions; a text without a licence under that digest is looked up once more with every line left
out that begins with "copyright" (``digest`` itself stays that of the first form).  Two units are looked up: the whole text, and each line on
its own against one-line notices.

The table of known digests is fixed in ``license_texts`` (under a hundred
rows), so it is broadcast.  A line is only normalised if it holds a term that every known notice has.

Defined results: null, empty and letterless texts have no digest and no licence;
every row is returned; equal notices of a text count once; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import license_texts as L
from ledgerline.session import checkpoint_dir

_COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©]*(?:copyright\s*(?:\(c\)|©|[0-9])|\(c\)\s*[0-9]|©|all rights reserved)[^\n]*$"
# any line that begins with the word, unless it goes on as running text of a licence does
_ANY_COPYRIGHT_LINE = (r"(?m)^[^\p{L}\p{N}\n©]*(?:copyright(?![\p{L}\p{N}])(?=[^\n]*[\p{L}\p{N}])"
                       r"(?![^\S\n]+(?:notice|holder|owner|licen[cs]e|law|interest)s?(?![\p{L}\p{N}]))"
                       r"|\(c\)\s*[0-9]|©|all rights reserved)[^\n]*$")
_TERMS = ("license",)       # a notice's canonical form has one of these


def canonical(text: Column, left_out: str = _COPYRIGHT_LINE) -> Column:
    """The canonical form of a text; empty becomes null."""
    t = F.regexp_replace(F.lower(text), left_out, "")
    t = F.btrim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for a, b in L.SPELLINGS:
        t = F.replace(t, F.lit(a.replace("-", " ")), F.lit(b))
    t = F.btrim(t)
    return F.when(t != "", t)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def bare_digest(text: Column) -> Column:
    """The digest without any copyright line; null where the text has no line that begins with the word."""
    return F.when(text.rlike(r"(?im)^[^\p{L}\p{N}\n©]*copyright"), F.sha2(canonical(text, _ANY_COPYRIGHT_LINE), 256))


def known(spark: SparkSession, rows: list[tuple[str, str]], digests: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(known_digest, license) of (licence, text) pairs and (licence, digest) pairs."""
    pairs = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(t).alias("text")) for a, t in rows])
    t = spark.range(1).select(F.explode(pairs).alias("p"))
    d = F.explode(F.array_compact(F.array(digest(F.col("p.text")), bare_digest(F.col("p.text")))))
    t = t.select(d.alias("known_digest"), "p.license")
    if digests:
        more = F.array(*[F.struct(F.lit(x).alias("known_digest"), F.lit(a).alias("license")) for a, x in digests])
        t = t.unionByName(spark.range(1).select(F.explode(more).alias("p")).select("p.known_digest", "p.license"))
    return t.distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         texts: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None,
         digests: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per input row: id, digest and licence of the whole text, and
    the sorted licences that its lines name."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    texts, notices = texts or L.TEXTS, notices or L.NOTICES
    term = "(?i)licen[cs]e"
    if not all(any(x in n.lower().replace("licence", "license") for x in _TERMS) for _, n in notices):
        term = "."
    digests = L.DIGESTS if digests is None else digests
    by_text = F.broadcast(known(spark, texts, digests))     # at most 2 * len(texts) + len(digests) rows
    by_bare = F.broadcast(known(spark, texts, digests).select(F.col("known_digest").alias("bare"), F.col("license").alias("bare_license")))
    by_line = F.broadcast(known(spark, notices).withColumnRenamed("license", "notice"))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(term))
    d = d.select("id", digest(F.col("text")).alias("digest"), bare_digest(F.col("text")).alias("bare"),
                 F.array_distinct(F.transform(lines, digest)).alias("lines"))
    d = d.join(by_text, F.col("digest") == F.col("known_digest"), "left").drop("known_digest").join(by_bare, "bare", "left")
    d = d.withColumn("license", F.coalesce("license", "bare_license")).drop("bare", "bare_license")
    # lines of a row stay in its task: its number within the run names it
    d = d.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    hits = (d.where("size(lines) > 0").select("row", F.explode("lines").alias("known_digest"))
            .join(by_line, "known_digest").groupBy("row").agg(F.array_sort(F.collect_set("notice")).alias("named")))
    none = F.array().cast("array<string>")
    plain = d.where("size(lines) = 0").select("id", "digest", "license", none.alias("named"))
    some = d.where("size(lines) > 0").join(hits, "row", "left").select("id", "digest", "license", F.coalesce("named", none).alias("named"))
    return plain.unionByName(some).withColumnRenamed("id", id_col)
