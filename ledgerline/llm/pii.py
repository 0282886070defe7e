"""Personal data: base patterns, and bootstrapped contextual extraction of
identifiers that no base pattern covers (DataFrame functions only).

Base kinds are e-mail addresses, IPv4 addresses, payment cards (Luhn) and
phone numbers.  They seed a pattern-instance graph:

* an instance is the string of a base span or of an identifier-like token outside base spans: a run
  of the characters of e-mail addresses, ``@`` and ``/`` with a digit, one of ``@ _ % +`` or an inner dot, or
  groups of digits written as in cards and phone numbers;
* a token of fewer than ``MIN_CHARS`` characters is known to be no identifier;
* a pattern is the lexical context alone: up to two words before it, whole and lower-cased, back to the token
  or span before; a context without a letter is none; neither words nor identifiers have an upper length;
* an edge is a distinct (pattern, instance), so copies of a text add nothing.

In each round a pattern's score is its number of trusted instances (seeds, and those with a
score of ``MIN_SCORE``) over that number, its known non-identifiers and ``PRIOR``; other
instances are unlabelled and count on neither side.  An instance's score is one minus the product of (1 - score) over its
patterns; seeds stay at 1.  Only patterns with at least ``MIN_SEEDS`` seeds
and a score of at least ``MIN_SCORE`` pass scores on.  After the last
round the instances of such patterns with a score of ``MIN_SCORE`` are discovered, and
each of their occurrences in such a context is reported as kind ``id``.

Every step is a grouped sum over distinct edges, partial before the shuffle.

Defined results: a null text is empty; texts with equal bytes are read once for
the graph and give equal results; every row is returned; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import spans as S
from ledgerline.session import checkpoint_dir

# Base patterns, fixed by the contract, written without repeated groups: a lazy
# run ends where the next characters can't go on.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])"
         r"[A-Za-z0-9.-]*?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])")
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?![0-9]|[\x20-][0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = (r"(?<![A-Za-z0-9_%+@/-])(?!\.)(?=[A-Za-z/-]*+(?:[0-9@_%+]|\.[A-Za-z0-9]))"
         r"[A-Za-z0-9_%+@/.-]*[A-Za-z0-9_/-]")
# digit groups with the separators of cards and phone numbers
GROUPS = (r"(?<![A-Za-z0-9_%+@/.-])[+(]?[0-9][0-9\x20().-]*?"
          r"(?![0-9]|[\x20().-][0-9]|\)[\x20-][0-9]|\x20\([0-9])(?![A-Za-z_%+@/]|[.-][A-Za-z])")
HIDDEN = "\x01"         # stands in the place of spans found before

MIN_CHARS = 6
ROUNDS = 3
MIN_SEEDS = 3
MIN_SCORE = 0.75
PRIOR = 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(t: Column) -> Column:
    d = _digits(t)
    at = F.sequence(F.lit(1), F.length(d))
    value = lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
    twice = lambda v: v * 2 - F.when(v > 4, 9).otherwise(0)
    total = F.aggregate(at, F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(value(i))).otherwise(value(i)))
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


def _parts_fit(t: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(t, "[.]"), lambda p: (F.length(part(p)) <= 3) & F.coalesce(
        F.when(F.length(part(p)) <= 3, F.concat(F.lit("0"), part(p)).cast("int")) <= 255, F.lit(False)))


def base(text: Column) -> Column:
    """Sorted base spans of a text (not null)."""
    digit = text.rlike("[0-9]")
    return S.labelled([
        ("email", S.find(text, EMAIL, text.contains("@"))),
        ("ip", F.filter(S.find(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda x: _parts_fit(x["t"]))),
        ("card", F.filter(S.find(text, CARD, digit & text.rlike(r"(?:[0-9][\x20-]?){11}[0-9]")), lambda x: _luhn(x["t"]))),
        ("phone", F.filter(S.find(text, PHONE, text.contains("+")), lambda x: F.length(_digits(x["t"])).between(9, 15)))])


def tokens(text: Column) -> Column:
    """Identifier-like tokens of a text, the short ones too."""
    like = lambda x: x["t"].rlike(r"[0-9@_%+]|\.[A-Za-z0-9]")
    return F.filter(S.find(text, TOKEN, text.rlike(TOKEN)), like)


def groups(text: Column) -> Column:
    """Identifier-like groups of digits with spaces or brackets between them."""
    like = lambda x: x["t"].rlike(r"[\x20()]") & (F.length(_digits(x["t"])) >= MIN_CHARS)
    return F.filter(S.find(text, GROUPS, text.rlike(r"[0-9][)\x20][\x20(-]?[0-9]")), like)


def _context(left: Column) -> Column:
    """Up to two words before the string, lower-cased, without marks in front; empty if they have no letter."""
    after = F.regexp_replace(left, f"(?s)^.*(?:{TOKEN}|{HIDDEN})", "")
    words = F.regexp_extract(F.lower(after), r"(?:(\S+)\s+)?(\S+)[\s]*$", 0)
    return F.regexp_replace(F.regexp_replace(F.btrim(words), r"^[^\p{L}]+", ""), r"\s+", " ")


def discovered(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, t) of discovered instances in trusted contexts, from
    occurrences (pattern, t, seed)."""
    edges = (occurrences.groupBy("pattern", "t").agg(F.max("seed").alias("seed"))
             .withColumn("non", ~F.col("seed") & (F.length("t") < MIN_CHARS)))
    # a pattern needs MIN_SEEDS seeds to ever pass a score on
    able = edges.groupBy("pattern").agg(F.count_if("seed").alias("k"), F.count_if("non").alias("non"),
                                        F.count(F.lit(1)).alias("n")).where(
        (F.col("k") >= MIN_SEEDS) & (F.col("n") > F.col("k") + F.col("non")))
    edges = edges.join(able.select("pattern"), "pattern", "left_semi").checkpoint()
    score = edges.groupBy("t").agg(F.max(F.col("seed").cast("double")).alias("score"))
    trusted = None
    known = F.count_if(F.col("score") >= MIN_SCORE)
    for _ in range(rounds):
        patterns = (edges.join(score, "t").groupBy("pattern")
                    .agg((known / (known + F.count_if("non") + PRIOR)).alias("p"))
                    .where(F.col("p") >= MIN_SCORE)).checkpoint()
        miss = F.sum(F.log(1 - F.least(F.col("p"), F.lit(1 - 1e-9))))
        score = (edges.join(patterns, "pattern", "left").groupBy("t")
                 .agg(F.max(F.col("seed").cast("double")).alias("own"), F.max("non").alias("non"),
                      (1 - F.exp(F.coalesce(miss, F.lit(0.0)))).alias("got"))
                 .select("t", F.greatest("own", F.when(F.col("non"), 0.0).otherwise(F.col("got"))).alias("score"))).checkpoint()
        trusted = patterns
    return (edges.where("not seed and not non").join(trusted.select("pattern"), "pattern")
            .join(score.where(F.col("score") >= MIN_SCORE).select("t"), "t").select("pattern", "t").distinct())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, base spans and discovered spans (s, nth, e, kind, t)."""
    checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    d = d.select("id", "key", "text", base(F.col("text")).alias("base"))
    d = d.select("id", "key", "base", S.mask(F.col("text"), F.col("base"), HIDDEN).alias("text"))
    d = d.select("id", "key", "base", "text", groups(F.col("text")).alias("groups"))
    d = d.select("id", "key", "base", F.array_sort(F.concat("groups", tokens(S.mask(F.col("text"), F.col("groups"), HIDDEN)))).alias("tokens")).checkpoint()
    some = d.where("size(base) + size(tokens) > 0").select("key", "base", "tokens").dropDuplicates(["key"])
    of = lambda c, seed: (some.select("key", F.explode(c).alias("x"))
                          .select("key", "x.s", "x.e", "x.t", _context(F.col("x.left")).alias("pattern"),
                                  F.lit(seed).alias("seed")).where("pattern <> ''"))
    seen = of("base", True).unionByName(of("tokens", False)).checkpoint()
    new = discovered(seen, rounds)
    ids = (seen.where("not seed").join(new, ["pattern", "t"])
           .groupBy("key").agg(F.array_sort(F.collect_set(F.struct("s", F.lit(4).alias("nth"), "e", F.lit("id").alias("kind"), "t"))).alias("ids")))
    none = F.array().cast("array<struct<s:int,nth:int,e:int,kind:string,t:string>>")
    slim = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["nth"].alias("nth"), x["e"].alias("e"),
                                                  x["kind"].alias("kind"), x["t"].alias("t")))
    plain = d.where("size(tokens) = 0").select("id", slim.alias("base"), none.alias("ids"))
    rest = d.where("size(tokens) > 0").join(ids, "key", "left").select("id", slim.alias("base"), F.coalesce("ids", none).alias("ids"))
    return plain.unionByName(rest).withColumnRenamed("id", id_col)
