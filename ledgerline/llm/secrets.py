"""Secret scans with multipart credential linking (DataFrame functions only).

Base findings are keyword assignments, access key ids and long hex runs.
Beyond these, weak parts of credentials -- account names, bare key-like
tokens, weakly named passwords, endpoints -- are reported only next to
complementary parts in the same scope (one text):

* an identifier with a secret within ``DISTANCE`` code points, and the other way round;
* an endpoint with both an identifier and a secret within that distance.

Base findings count as parts (access: identifier; assign, hex: secret).

The interval join works on cells of ``DISTANCE`` code points: a part's
interval, widened by the distance, meets per-cell minima of starts and maxima
of ends of the other role, one row per text, cell and role.  A widened interval
ends in a cell or covers it, so the minimum and maximum decide exactly, and
no pairs are listed however many parts a text has.

Defined results: a null text is empty; texts with equal bytes are linked once and give equal
results; every row is returned; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import spans as S
from ledgerline.session import checkpoint_dir

DISTANCE = 200

# Base patterns, fixed by the contract; an assignment's value is its longest run of value characters.
_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_ASSIGN_HEAD = "^" + _KEYWORD + r"""["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Weak parts.
_END = r"""["']?\x20*[:=]\x20*["']?"""
NAMED_ID = r"(?i:access[_-]?key(?:[_-]?id)?|client[_-]?id|user(?:[_-]?name)?|login|account)" + _END + r"[A-Za-z0-9._@+-]{3,}+"
NAMED_SECRET = r"(?i:pwd|pass|passphrase|credential|private[_-]?key|auth(?:[_-]?key)?)" + _END + r"[A-Za-z0-9+/_.=!@#$%^&*-]{4,}+"
BARE_KEY = r"(?:\G|(?<![A-Za-z0-9+/=_-]))[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?:\G|(?<![A-Za-z0-9+.-]))[A-Za-z][A-Za-z0-9+.-]{1,}+://[^\s\"'<>]{3,}+"

IDENTIFIER, SECRET, PLACE = "identifier", "secret", "endpoint"


def base(text: Column) -> Column:
    """Sorted base spans of a text (not null)."""
    assign = F.filter(S.find(text, ASSIGN, text.rlike(_KEYWORD)),
                      lambda x: F.length(F.regexp_replace(x["t"], _ASSIGN_HEAD, "")) >= 6)
    return S.labelled([("assign", assign), ("access", S.find(text, ACCESS, text.contains("AKIA"))),
                       ("hex", S.find(text, HEX, text.rlike(HEX)))])


def weak(text: Column) -> Column:
    """Sorted weak parts; ``kind`` is the role."""
    named = lambda p: S.find(text, p, text.rlike(p))
    mixed = lambda x: (x["t"].rlike("[0-9]") & x["t"].rlike("[a-z]") & x["t"].rlike("[A-Z]"))
    return S.labelled([(IDENTIFIER, named(NAMED_ID)), (SECRET, named(NAMED_SECRET)),
                       (SECRET, F.filter(named(BARE_KEY), mixed)), (PLACE, S.find(text, ENDPOINT, text.contains("://")))])


def _linked(parts: DataFrame, distance: int) -> DataFrame:
    """(key, s, e, kind) of the weak parts with complementary parts in reach.

    ``parts``: key, s, e, kind (role), weak."""
    cells = lambda a, b: F.sequence(F.floor(a / distance), F.floor(b / distance))
    there = (parts.withColumn("cell", F.explode(cells(F.col("s"), F.col("e"))))
             .groupBy("key", "cell", F.col("kind").alias("other"))
             .agg(F.min(F.greatest(F.col("s"), F.col("cell") * distance)).alias("first"),
                  F.max(F.least(F.col("e"), (F.col("cell") + 1) * distance)).alias("last")))
    low, high = F.col("s") - distance, F.col("e") + distance
    reach = parts.where("weak").withColumn("cell", F.explode(cells(F.greatest(low, F.lit(0)), high)))
    met = reach.join(there, ["key", "cell"]).where(
        (F.col("kind") != F.col("other")) & (F.col("first") <= high) & (F.col("last") >= low))
    roles = met.groupBy("key", "s", "e", "kind").agg(F.collect_set("other").alias("roles"))
    has = lambda r: F.array_contains("roles", r)
    return roles.where(((F.col("kind") == IDENTIFIER) & has(SECRET)) | ((F.col("kind") == SECRET) & has(IDENTIFIER))
                       | ((F.col("kind") == PLACE) & has(IDENTIFIER) & has(SECRET))).select("key", "s", "e", "kind")


def _parts(docs: DataFrame, text: Column, *columns: Column) -> DataFrame:
    """``columns``, key (digest of the text), base findings and weak parts outside of them."""
    d = docs.select(*columns, F.unhex(F.md5(text)).alias("key"), text.alias("body"))
    d = d.select("*", base(F.col("body")).alias("base"))
    # a weak part inside a base finding is that finding
    return d.withColumn("weak", weak(S.mask(F.col("body"), F.col("base")))).drop("body")


def _links(d: DataFrame, distance: int) -> DataFrame:
    """(key, linked): the linked spans of the texts that have any; ``d`` has key, base and weak."""
    role = F.when(F.col("b.kind") == "access", IDENTIFIER).otherwise(SECRET)
    some = d.where("size(weak) > 0").select("key", "base", "weak").dropDuplicates(["key"])
    parts = (some.select("key", F.explode("weak").alias("w")).select("key", "w.s", "w.e", "w.kind", F.lit(True).alias("weak"))
             .unionByName(some.select("key", F.explode("base").alias("b"))
                          .select("key", "b.s", "b.e", role.alias("kind"), F.lit(False).alias("weak"))))
    nth = F.when(F.col("kind") == IDENTIFIER, 3).when(F.col("kind") == SECRET, 4).otherwise(5)
    return (_linked(parts, distance).groupBy("key")
            .agg(F.array_sort(F.collect_set(F.struct("s", nth.alias("nth"), "e", "kind"))).alias("linked")))


LINKED = "array<struct<s:int,nth:int,e:int,kind:string>>"


def _slim(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["nth"].alias("nth"), x["e"].alias("e"), x["kind"].alias("kind")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per input row: id, base spans, linked spans (s, nth, e, kind)."""
    checkpoint_dir(docs.sparkSession)
    d = _parts(docs, F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).alias("id")).checkpoint()
    none = F.array().cast(LINKED)
    plain = d.where("size(weak) = 0").select("id", _slim(F.col("base")).alias("base"), none.alias("linked"))
    rest = d.where("size(weak) > 0").join(_links(d, distance), "key", "left").select(
        "id", _slim(F.col("base")).alias("base"), F.coalesce("linked", none).alias("linked"))
    return plain.unionByName(rest).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[secret]",
           distance: int = DISTANCE) -> DataFrame:
    """The input's rows and columns; each run of overlapping base and linked spans in the text is
    replaced by ``mark``, and the number of characters is brought up to date.

    All patterns run once: the rows are written with their parts to the shared folder and read
    again.  Only rows with weak parts are shuffled, to get their links."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/secrets-{uuid.uuid4().hex}"
    d = _parts(docs, F.coalesce(F.col(text_col), F.lit("")), F.struct("*").alias("row"))
    d.withColumns({"base": _slim(F.col("base")), "weak": _slim(F.col("weak"))}).write.parquet(path)
    d = spark.read.parquet(path)
    body = F.col(f"row.{text_col}")

    def clean(rows: DataFrame, found: Column) -> DataFrame:
        rows = rows.select("row", S.merged(found).alias("runs"))
        rows = rows.select("row", "runs", S.replaced(body, F.col("runs"), lambda x: F.lit(mark)).alias("new"))
        row = F.col("row").withField(text_col, F.col("new"))
        if chars_col in docs.columns:
            row = row.withField(chars_col, F.length("new").cast(docs.schema[chars_col].dataType))
        return rows.select(F.when(F.size("runs") > 0, row).otherwise(F.col("row")).alias("row")).select("row.*")

    weak_rows = d.where("size(weak) > 0").join(_links(d, distance), "key", "left")
    both = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(LINKED))))
    return clean(d.where("size(weak) = 0"), F.col("base")).unionByName(clean(weak_rows, both))
