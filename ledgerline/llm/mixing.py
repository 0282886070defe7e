"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Targets.  Sources share a total number of words by weight; a target stops at
``max_copies`` times the words of its source, and the excess is shared again
by weight until none is above.  Each round of sharing is one aggregate over
the table of sources; only its two sums come to the driver.

Copies.  A source's target first gives every document ``floor(target / size of
the source)`` certain whole copies.  The rest is a Pareto sample without
replacement: document i has inclusion probability p_i, proportional to its
inclusion weight and scaled so that the expected words meet the rest, draws u_i from a
digest of its id and text, and is ranked by [u_i / (1 - u_i)] / [p_i / (1 - p_i)];
the smallest ranks are taken until their words come nearest to the rest.

The cut is found without sorting a source: ranks fall into 2^13 cells, and
the cell where the target is crossed into 2^13 cells again; each step is a
partial aggregate, so a source with a third of all rows is no hot spot.

Defined results: a null text has no words; null is a source of its own, ordered
last; rows equal in id and text share one draw; a source without words has
target 0; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import checkpoint_dir

CELLS = 13                          # bits of each of the two steps of the cut
BROADCAST_SOURCES = 50_000          # per-source rows of under 200 bytes: 10 MB at most
_SPACE = "\t\n\u000b\f\r "


def n_words(text: Column) -> Column:
    r"""Number of words ``[^\x20\x09-\x0D]+``."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def draw(id_: Column, text: Column, seed: str) -> Column:
    """A fixed number in (0, 1) from 52 bits of a digest of the id and the text."""
    name = F.concat_ws("|", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit("")))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def numbered(values: DataFrame, col: str) -> DataFrame:
    """``values`` with ``nth``: 0-based position in code point order, null last.

    A range sort numbers rows within partitions; one count per partition gives the offsets."""
    checkpoint_dir(values.sparkSession)
    v = values.orderBy(F.col(col).asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("at", 33)
    sizes = v.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return (v.withColumn("part", part).join(F.broadcast(before), "part")      # one row for each partition
            .withColumn("nth", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "before"))


def cycled_weights(sources: DataFrame, col: str, cycle=(3, 1, 2)) -> DataFrame:
    """(col, weight): the cycle's weights, repeating, in code point order."""
    cycle = F.array(*[F.lit(float(x)) for x in cycle])
    return (numbered(sources.select(col).distinct(), col)
            .select(col, F.element_at(cycle, (F.col("nth") % F.size(cycle) + 1).cast("int")).alias("weight")))


def targets(sizes: DataFrame, share: float, max_copies: int) -> DataFrame:
    """``sizes`` (source_size, weight, ...) with ``target``."""
    cap = max_copies * F.col("source_size")
    total, all_weight = sizes.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total or not all_weight:
        return sizes.withColumn("target", F.lit(0.0))
    level = share * total / all_weight
    full = -1
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        n, words, weight = sizes.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not weight:
            break
        full, level = n, (share * total - (words or 0)) / weight
    return sizes.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _join_sources(rows: DataFrame, per_source: DataFrame, n_sources: int) -> DataFrame:
    side = per_source.withColumnRenamed("source", "of")
    if n_sources <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, _same(F.col("source"), F.col("of"))).drop("of")


def _inclusion(size: Column) -> Column:
    """Inclusion weight: one over the root of the size, so that a pick's words vary less."""
    return 1 / F.sqrt(F.greatest(size, F.lit(1)).cast("double"))


def _cell(scale: Column, size: Column, u: Column) -> Column:
    """The document's Pareto rank q, as cell number of q / (1 + q)."""
    p = F.least(F.greatest(scale * _inclusion(size), F.lit(1e-9)), F.lit(1 - 1e-9))
    q = (u / (1 - u)) / (p / (1 - p))
    top = (1 << (2 * CELLS)) - 1
    return F.least(F.floor(q / (1 + q) * float(top + 1)), F.lit(top)).cast("long")


def _crossing(cells: DataFrame, col: str) -> DataFrame:
    """Per source the cell in which the running words pass ``rest``, and the words before it."""
    w = Window.partitionBy("source").orderBy(col)
    run = cells.withColumn("upto", F.sum("words").over(w))
    at = run.where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
    return at.groupBy("source").agg(F.min(F.struct(col, (F.col("upto") - F.col("words")).alias("before"), "words")).alias("x"))


def cuts(slim: DataFrame, weights: DataFrame, share: float, max_copies: int) -> tuple[DataFrame, int]:
    """(per source: source_size, target, certain copies, scale, cut; number of
    sources) for ``slim`` (source, size, u)."""
    # integer sums, so that reruns agree to the last bit
    unit = F.round(F.col("size") * _inclusion(F.col("size")) * 1024).cast("long")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(unit).alias("units"))
    w = weights.withColumnRenamed("source", "of")
    sizes = sizes.join(w, _same(F.col("source"), F.col("of"))).drop("of").checkpoint()
    n_sources = sizes.count()
    s = targets(sizes, share, max_copies)
    certain = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("certain", certain)
    s = s.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    s = s.withColumn("scale", F.when(F.col("units") > 0, F.col("rest") * 1024 / F.col("units")).otherwise(0.0)).checkpoint()

    open_ = s.where("rest > 0").select("source", "rest", "scale")
    cell = _join_sources(slim, open_, n_sources).select(
        "source", "rest", "size", _cell(F.col("scale"), F.col("size"), F.col("u")).alias("cell"))
    cell = cell.withColumn("c1", F.shiftright("cell", CELLS)).withColumn("c2", F.col("cell").bitwiseAND((1 << CELLS) - 1))
    one = _crossing(cell.groupBy("source", "rest", "c1").agg(F.sum("size").alias("words")), "c1")
    one = one.select("source", F.col("x.c1").alias("at1"), F.col("x.before").alias("before")).checkpoint()
    two = (_join_sources(cell, one, n_sources).where("c1 = at1")
           .groupBy("source", (F.col("rest") - F.col("before")).alias("rest"), "c2").agg(F.sum("size").alias("words")))
    with_rest = _crossing(two, "c2").select("source", F.col("x.c2").alias("at2"), F.col("x.before").alias("before2"),
                                            F.col("x.words").alias("words2"))
    side = one.join(with_rest.withColumnRenamed("source", "of"), _same(F.col("source"), F.col("of"))).drop("of")
    out = s.join(side.withColumnRenamed("source", "of"), _same(F.col("source"), F.col("of")), "left").drop("of")
    left = F.col("rest") - F.col("before") - F.col("before2")
    # the crossing cell is taken where that comes nearer to the target
    last = F.col("at1") * (1 << CELLS) + F.col("at2") - F.when(2 * left >= F.col("words2"), 0).otherwise(1)
    return out.select("source", "source_size", "target", "certain", "scale",
                      F.coalesce(last, F.lit(-1)).cast("long").alias("last")).checkpoint(), n_sources


def _copies() -> Column:
    more = _cell(F.col("scale"), F.col("size"), F.col("u")) <= F.col("last")
    return F.col("certain") + F.when(more & (F.col("last") >= 0), 1).otherwise(0)


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text).alias("size"),
                       draw(F.col(id_col), text, seed).alias("u"))


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, max_copies: int = 2, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken (words).

    ``weights`` is (source, weight); by default 3, 1, 2 repeating in source order."""
    checkpoint_dir(docs.sparkSession)
    slim = _slim(docs, id_col, text_col, source_col, seed).checkpoint()
    w = weights if weights is not None else cycled_weights(slim, "source")
    per_source, n = cuts(slim, w, share, max_copies)
    out = _join_sources(slim, per_source, n).withColumn("copies", _copies().cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, max_copies: int = 2, seed: str = "mix",
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The input's rows that the mix takes, all columns in ``row.*``, and ``copies`` (over 0)."""
    checkpoint_dir(docs.sparkSession)
    slim = _slim(docs, id_col, text_col, source_col, seed).checkpoint()
    w = weights if weights is not None else cycled_weights(slim, "source")
    per_source, n = cuts(slim, w, share, max_copies)
    text = F.col(text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), n_words(text).alias("size"),
                       draw(F.col(id_col), text, seed).alias("u"))
    return (_join_sources(rows, per_source, n).select("row", _copies().cast("long").alias("copies"))
            .where("copies > 0"))
