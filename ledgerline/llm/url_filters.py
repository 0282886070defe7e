"""URL verdicts: explicit rules first, then empirical-Bayes host reputation
(DataFrame functions only).

Labelled page outcomes (good or bad) are counted by host.  Bad rates are
shrunk with beta-binomial priors from the whole to the suffix (last label), from suffix to registered
domain (last two labels), and from domain to host; a level's prior strength
comes from the spread of its groups (method of moments).  A host is blocked
when the lower bound of its posterior bad rate is above the limit.

Work per page is one join with a table of one row per host, which carries the
host's reputation and the rules that fit it.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule, and gets the reputation of the empty host; a label that repeats counts once
(a page is bad if any of its labels is); unlabelled hosts inherit their domain's or
suffix's rate; every page row is returned; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import checkpoint_dir

LIMIT = 0.5             # highest bad rate that passes ...
Z = 1.645               # ... with the posterior's lower bound at so many deviations
MAX_STRENGTH = 1e6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    p = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    p = p.select("id", F.expr("if(instr(url, '://') > 0, substr(url, instr(url, '://') + 3), '')").alias("rest"))
    p = p.select("id", "rest", F.regexp_extract("rest", r"^[^/?#]*", 0).alias("raw"))
    return p.select("id", F.translate("raw", _UPPER, _LOWER).alias("host"),
                    F.regexp_extract(F.expr("substr(rest, length(raw) + 1)"), r"^[^?#]*", 0).alias("path"))


def _last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def _strength(groups: DataFrame, rate: Column) -> float:
    """Prior strength of a level from its groups (n, k) around their parents' rates."""
    p = F.col("k") / F.col("n")
    r = groups.where("n > 0").agg(
        F.sum(F.col("n") * (p - rate) * (p - rate)).alias("spread"), F.sum(rate * (1 - rate)).alias("noise"),
        F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        F.avg(rate * (1 - rate)).alias("var")).first()
    if not r["n"] or not r["var"]:
        return MAX_STRENGTH
    room = r["n"] - r["n2"] / r["n"]
    between = (r["spread"] - r["noise"]) / room if room > 0 else 0.0
    return MAX_STRENGTH if between <= 0 else min(MAX_STRENGTH, max(1.0, r["var"] / between - 1))


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, n, k, bad_rate, bad_low) from (host, n, k): labelled and bad pages of each host."""
    h = hosts.select("host", "n", "k", _last_labels(F.col("host"), 2).alias("domain"), _last_labels(F.col("host"), 1).alias("suffix"))
    h = h.checkpoint()
    total = h.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    m0 = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)

    def shrunk(level: DataFrame, rate: Column) -> DataFrame:
        s = _strength(level, rate)
        return level.withColumn("rate", (F.col("k") + s * rate) / (F.col("n") + s))

    suffix = shrunk(h.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), F.lit(m0))
    domain = h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domain = domain.join(suffix.select("suffix", F.col("rate").alias("up")), "suffix").checkpoint()
    domain = shrunk(domain, F.col("up")).select("domain", "suffix", F.col("rate").alias("up"))
    host = h.join(domain, ["domain", "suffix"]).checkpoint()
    s = _strength(host, F.col("up"))
    a, b = F.col("k") + s * F.col("up"), F.col("n") - F.col("k") + s * (1 - F.col("up"))
    mean = a / (a + b)
    return host.select("host", "n", "k", mean.alias("bad_rate"),
                       (mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bad_low"))


def rules_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule_host, rules) from (verdict, 'host/path') pairs: rules of a host in one array."""
    rows = [F.struct(F.lit(r.split("/", 1)[0]).alias("rule_host"), F.lit("/" + r.split("/", 1)[1]).alias("path"),
                     F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]
    t = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return t.groupBy("rule_host").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "verdict", "path")).alias("rules"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, limit: float = LIMIT,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page row: id, host, path, rule, verdict, bad_rate, bad_low.

    ``outcomes`` is (id, bad): labelled pages; ``rules`` as from ``rules_table``."""
    checkpoint_dir(pages.sparkSession)
    p = _parsed(pages, id_col, url_col)
    bad = outcomes.groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad")).where("bad is not null")
    counts = (p.select("id", "host").join(bad, "id", "left").groupBy("host")
              .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))).checkpoint()
    ends = counts.select("host", F.explode(F.expr(
        "transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")).alias("rule_host"))
    fitting = ends.join(rules, "rule_host").groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    hosts = reputation(counts).join(fitting, "host", "left").checkpoint()
    best = F.expr("array_max(filter(rules, r -> startswith(path, r.path)))")
    out = p.join(hosts, "host").withColumn("best", best)
    verdict = F.coalesce("best.verdict", F.when(F.col("bad_low") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"),
                      "bad_rate", "bad_low")
