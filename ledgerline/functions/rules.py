"""Column-level rules shared by all operators (built-in functions only).

Each helper returns a ``Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# Leading numeric prefix as read by a lenient number parser ("12.5kg" -> 12.5,
# "abc" -> null).  Integer variant for quantities ("3 pcs" -> 3).
_FLOAT_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
_INT_PREFIX = r"^\s*([+-]?\d+)"


def ident(name: str) -> str:
    """Quote one identifier for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def effective_sale(status="status") -> Column:
    """Sale counts unless its status starts with C or R (any case).

    Cancel (C..), return (R..) and the literals CANCELED / RETURNED / refund
    are all excluded; exchanges (E..) stay in.
    """
    s = col_(status)
    return ~s.ilike("C%") & ~s.ilike("R%")


def effective_sale_strict(status="status") -> Column:
    """Case-sensitive variant used by the live channel-A analytics."""
    s = F.coalesce(col_(status), F.lit(""))
    return ~s.startswith("C") & ~s.startswith("R")


def js_round(x) -> Column:
    """``Math.round``: floor(x + 0.5) as BIGINT (differs from SQL ROUND on
    negative halves)."""
    return F.floor(col_(x) + F.lit(0.5)).cast("bigint")



def js_rate(num, den) -> Column:
    """``Math.round(num / den * 1000) / 10``: a percentage to one decimal,
    evaluated in the same operation order as the source (DOUBLE)."""
    x = col_(num).cast("double") / col_(den).cast("double") * F.lit(1000.0)
    return (F.floor(x + F.lit(0.5)) / F.lit(10.0)).cast("double")


def falsy_coalesce(*cols, default=None, kind: str = "text") -> Column:
    """JS ``a || b || default``: the first value that is not falsy.

    ``kind`` says what falsy means for the inputs: ``"text"`` -- null or ''
    (the string "0" is truthy in JS); ``"number"`` -- null, 0 or NaN;
    ``"cell"`` -- a spreadsheet cell exported as text: null, blank, or a
    numeric zero such as "0" / "0.00".
    """
    parts = [F.when(~falsy(c, kind), col_(c)) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


_ZERO_TEXT = r"^\s*[+-]?(0+(\.0*)?|\.0+)\s*$"


def falsy(c, kind: str = "text") -> Column:
    """True where JS would treat the value as false (see ``falsy_coalesce``)."""
    c = col_(c)
    if kind == "number":
        return c.isNull() | (c == F.lit(0)) | F.isnan(c.cast("double"))
    if kind == "cell":
        t = c.cast("string")
        return c.isNull() | (F.trim(t) == F.lit("")) | t.rlike(_ZERO_TEXT)
    return c.isNull() | (c.cast("string") == F.lit(""))


def nonempty(c) -> Column:
    c = col_(c)
    return c.isNotNull() & (c != F.lit(""))



def lenient_double(c) -> Column:
    """``parseFloat``: leading numeric prefix of a string, else null."""
    txt = F.regexp_extract(col_(c).cast("string"), _FLOAT_PREFIX, 1)
    return F.when(txt != F.lit(""), txt).try_cast("double")


def lenient_int(c) -> Column:
    """``parseInt``: leading integer prefix of a string, else null."""
    txt = F.regexp_extract(col_(c).cast("string"), _INT_PREFIX, 1)
    return F.when(txt != F.lit(""), txt).try_cast("bigint")



def money(c) -> Column:
    return col_(c).cast(MONEY)



ORDER_PARTITIONS = ("channel", "order_month")
UNDATED_MONTH = 0


def order_month(date_col="order_date") -> Column:
    """The month partition of the order table: integer yyyymm, never null
    (lines without a date are kept in ``UNDATED_MONTH``)."""
    d = col_(date_col).cast("date")
    return F.coalesce(F.year(d) * 100 + F.month(d), F.lit(UNDATED_MONTH)).cast("int")


def month_prune(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Add a filter on the ``order_month`` partition column (yyyymm) implied
    by an ``order_date`` window, so the scan skips whole folders.  No-op for
    frames without that column."""
    if "order_month" not in df.columns:
        return df
    if start:
        df = df.where(F.col("order_month") >= int(start[:4]) * 100 + int(start[5:7]))
    if end:
        df = df.where(F.col("order_month") <= int(end[:4]) * 100 + int(end[5:7]))
    return df


def date_text(c) -> Column:
    """Dates leave the engine as 'YYYY-MM-DD' text, like the source system."""
    return col_(c).cast("date").cast("string")


def contains_text(c, needle: str) -> Column:
    """Case-insensitive literal substring test (``%`` and ``_`` are literal)."""
    return F.lower(F.coalesce(col_(c), F.lit(""))).contains(needle.lower())


def search_any(cols: Sequence, needle: str | None) -> Column:
    if not needle:
        return F.lit(True)
    cond = F.lit(False)
    for c in cols:
        cond = cond | contains_text(c, needle)
    return cond


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep one row per key: the one with the greatest ``order`` tuple.

    ``row_number() = 1`` over the key ordered by ``order`` descending: Spark
    plans it with a partial ``WindowGroupLimit`` before the shuffle, so a key
    with millions of copies is cut to one row per map task instead of
    landing whole in one task.  The remaining columns extend the ordering,
    so full ties on ``order`` resolve the same way on every run (safe under
    task retries).  Nulls sort lowest, as in a ``max``.
    """
    from pyspark.sql import Window
    payload = [c for c in df.columns if c not in keys and c not in order]
    w = Window.partitionBy(*[F.col(ident(k)) for k in keys]).orderBy(
        *[F.col(ident(c)).desc_nulls_last() for c in list(order) + payload])
    return (df.withColumn("_lw_rn", F.row_number().over(w)).where(F.col("_lw_rn") == 1)
              .select(*[F.col(ident(k)) for k in keys], *[F.col(ident(c)) for c in list(order) + payload]))


def numbered(df: DataFrame, order: str, name: str = "row_no", buckets: int | None = None) -> DataFrame:
    """Number rows 1..n by the numeric column ``order`` without a global sort
    in one task.

    Rows are cut into ``buckets`` equal-width ranges of ``order`` (bounds are
    scalar subqueries, so every evaluation sees the same buckets); each
    bucket is numbered by a window, and the bucket's offset comes from
    per-bucket counts (one row per bucket: a proven bound for the broadcast).
    """
    from pyspark.sql import Window
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lo = df.select(F.min(order)).scalar()
    hi = df.select(F.max(order)).scalar()
    width = F.greatest((hi - lo + F.lit(1)) / F.lit(n), F.lit(1.0))
    t = df.withColumn("_b", F.floor((F.col(order) - lo) / width))
    counts = t.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    ranked = t.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(order)))
    return (ranked.join(F.broadcast(offsets.select("_b", "_off")), "_b")
                  .withColumn(name, (F.col("_off") + F.col("_r")).cast("bigint"))
                  .drop("_b", "_off", "_r"))


def numbered_by_blocks(df: DataFrame, block: Sequence[str], order: str, name: str = "no") -> DataFrame:
    """Number rows 1..n by ``block``, then ``order``, without gaps and without sorting all rows in one task.

    A block holds a bounded number of rows (e.g. the rows of one split of a file); each is
    numbered by itself, and starts after the running count of the blocks before it (one row a block)."""
    from pyspark.sql import Window
    keys = [F.col(c) for c in block]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.join(offsets, list(block)).withColumn(name, (F.col("_off") + F.col("_r")).cast("bigint")).drop("_off", "_r")


# ---------------------------------------------------------------------------------------
# The same rules as SQL expression text.  A projection written as text is
# parsed by the JVM in one call (``selectExpr`` / ``F.expr``) instead of one
# call per function node, which keeps plan construction cheap for the wide
# per-row normalisations.  Arguments are SQL snippets (column names, field
# paths such as ``it.quantity``, or other snippets from these helpers).
# ---------------------------------------------------------------------------------------

_FLOAT_PREFIX_SQL = _FLOAT_PREFIX.replace("\\", "\\\\")
_INT_PREFIX_SQL = _INT_PREFIX.replace("\\", "\\\\")
_ZERO_TEXT_SQL = _ZERO_TEXT.replace("\\", "\\\\")


def lit_sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def falsy_sql(x: str, kind: str = "text") -> str:
    if kind == "number":
        return f"({x} IS NULL OR {x} = 0 OR isnan(CAST({x} AS DOUBLE)))"
    if kind == "cell":
        return (f"({x} IS NULL OR trim(CAST({x} AS STRING)) = '' "
                f"OR CAST({x} AS STRING) RLIKE '{_ZERO_TEXT_SQL}')")
    return f"({x} IS NULL OR CAST({x} AS STRING) = '')"


def or_sql(*xs: str, default=None, kind: str = "text") -> str:
    """``a || b || default`` as SQL (see ``falsy_coalesce``)."""
    parts = [f"CASE WHEN NOT {falsy_sql(x, kind)} THEN {x} END" for x in xs]
    if default is not None:
        parts.append(lit_sql(default))
    return parts[0] if len(parts) == 1 else f"coalesce({', '.join(parts)})"


def parse_float_sql(x: str) -> str:
    """``parseFloat`` as SQL: leading numeric prefix, else NULL."""
    return f"try_cast(nullif(regexp_extract(CAST({x} AS STRING), '{_FLOAT_PREFIX_SQL}', 1), '') AS DOUBLE)"


def parse_int_sql(x: str) -> str:
    """``parseInt`` as SQL: leading integer prefix, else NULL."""
    return f"try_cast(nullif(regexp_extract(CAST({x} AS STRING), '{_INT_PREFIX_SQL}', 1), '') AS BIGINT)"


def eff_sql(status: str = "status") -> str:
    return f"(NOT {status} ILIKE 'C%' AND NOT {status} ILIKE 'R%')"


def js_round_sql(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def js_rate_sql(num: str, den: str) -> str:
    return f"CAST(floor(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 1000.0 + 0.5) / 10.0 AS DOUBLE)"


def money_sql(x: str) -> str:
    return f"CAST({x} AS {MONEY})"


def day_sql(*xs: str) -> str:
    """``(a || b || '').substring(0, 10)`` as text, NULL when empty."""
    return f"nullif(substring({or_sql(*xs, default='')}, 1, 10), '')"
