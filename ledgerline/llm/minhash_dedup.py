"""Near-duplicate documents: min-max hashing, banding, exact confirmation.

Signature.  Under each of a number of hash functions both the smallest
and the largest value of a document's shingle set are kept; either one agrees
between two sets with probability J, so 40 hash evaluations a shingle give 80
signature values.  Values form bands of ``ROWS``, as many as keep the probability that
a pair at the threshold shares none within ``MISS``: 20 at J = 0.85 (40 functions,
(1 - 0.85^4)^20 = 4e-7), 28 at J = 0.8 (56 functions).

Links.  Documents with equal sets form a class and are represented by their
smallest id.  Representatives that share a band are confirmed on their whole sets
in two steps, so that a large group never becomes all of its pairs:

1. in each band bucket every member is compared with the bucket's hub (the
   member with most company over all bands), and the links give components;
2. buckets that still hold several components compare each member outside the
   hub's component with every other member: small buckets as pairs, larger ones in
   blocks inside tasks, which send back only confirmed links.

Members that are already connected need no further comparison, all others get
it, so components are complete with respect to the shared bands.

Defined results: a null, empty or word-less text has no shingles, is linked
with nothing and kept; a null id has no component and is kept; rows that repeat
an id are one node (confirmed by its smallest text), and each row is returned; other columns are not read.
``keep_one`` judges rows by id and text instead, so that an id's unrelated texts all stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import words as W
from ledgerline.llm.bitmap import Bitmap
from ledgerline.llm.graph import components
from ledgerline.session import checkpoint_dir

SHINGLE = 5
ROWS = 4
MISS = 4e-7                             # how often a pair at the threshold may share no band
MIN_PERCENT = 85                        # 100 * intersection >= MIN_PERCENT * union
SMALL_BUCKET = 32                       # up to here the rest of a bucket is compared as pairs
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 18

_BAND = W.random_words(33, ROWS) | W.U64(1)

SIGNATURE = "struct<n:bigint,hi:bigint,lo:bigint,bands:array<bigint>>"


def sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bounds): the distinct shingles of each text, sorted."""
    w = W.split(data, off, W.SPACED)
    h, doc, _ = W.shingles(w, k)
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(off)))


def bands_for(percent: int) -> int:
    """Bands that find a pair at the threshold but with probability ``MISS``."""
    return 1 if percent >= 100 else math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def min_max(h: np.ndarray, bounds: np.ndarray, permutations: int = 40) -> np.ndarray:
    """Signature values, one column per non-empty set: all minima, then all maxima."""
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((2 * permutations, len(at)), dtype=W.U64)
    xor, mul = W.random_words(31, permutations), W.random_words(32, permutations) | W.U64(1)
    for p in range(permutations):
        v = (h ^ xor[p]) * mul[p]
        out[p] = np.minimum.reduceat(v, at)
        out[permutations + p] = np.maximum.reduceat(v, at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, bands) fingerprints of consecutive groups of ROWS values."""
    s = signature.reshape(len(signature) // ROWS, ROWS, -1)
    keys = (s * _BAND[None, :, None]).sum(axis=1, dtype=W.U64) + np.arange(1, len(s) + 1, dtype=W.U64)[:, None]
    return W.mix(keys).T


def signature(text: Column, k: int = SHINGLE, percent: int = MIN_PERCENT) -> Column:
    """struct<n, hi, lo, bands>: size and 128-bit digest of the set, band keys."""
    count = bands_for(percent)

    @F.arrow_udf(SIGNATURE)
    def sign(texts: pa.Array) -> pa.Array:
        size, hi, lo, keys = [], [], [], []
        for data, off, _, _ in W.chunks(texts):
            h, bounds = sets(data, off, k)
            n = np.diff(bounds)
            has = n > 0
            a, b = np.zeros(len(n), W.U64), np.zeros(len(n), W.U64)
            bands = np.zeros((len(n), count), W.U64)
            if len(h):
                at = bounds[:-1][has]
                a[has] = np.add.reduceat(W.mix(h ^ W.U64(0x5851F42D4C957F2D)), at)
                b[has] = np.add.reduceat(W.mix(h * W.U64(0x2545F4914F6CDD1D)), at)
                bands[has] = band_keys(min_max(h, bounds, count * ROWS // 2))
            size.append(n)
            hi.append(a)
            lo.append(b)
            keys.append((bands[has].reshape(-1), has))
        n = np.concatenate(size) if size else np.zeros(0, np.int64)
        flat = np.concatenate([x[0] for x in keys]) if keys else np.zeros(0, W.U64)
        ends = np.concatenate(([0], np.cumsum((n > 0) * count)))
        col = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else [], pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), col(hi), col(lo),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))],
            ["n", "hi", "lo", "bands"])

    return sign(text)


def linked(a: Column, b: Column, k: int = SHINGLE, percent: int = MIN_PERCENT) -> Column:
    """Whether two texts' whole shingle sets are similar enough."""

    @F.arrow_udf("boolean")
    def compare(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(xs, ys):
            h, bounds = sets(*W.buffer(pa.array([x.as_py(), y.as_py()], pa.string())), k)
            u, v = h[: bounds[1]], h[bounds[1]:]
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(both > 0 and 100 * both >= percent * (len(u) + len(v) - both))
        return pa.array(out, pa.bool_())

    return compare(a, b)


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class _Texts:
    """Texts of the ids that take part in a comparison; a bitmap of these ids
    keeps other texts out of the shuffle."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    def of(self, ids: DataFrame) -> DataFrame:
        seen = Bitmap(ids, "id")
        near = self.docs.where(seen.might_have(F.col("id")))
        # a repeated id is one node; its smallest text stands for it
        return near.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def _confirm(pairs: DataFrame, texts: _Texts, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are linked."""
    pairs = pairs.checkpoint()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    t = texts.of(ids).checkpoint()
    left = pairs.join(t.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    full = left.join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return full.where(linked(F.col("ta"), F.col("tb"), k, percent)).select("a", "b").checkpoint()


def _blocks(members: DataFrame, texts: _Texts, k: int, percent: int) -> DataFrame:
    """Links of the strays of large buckets: (key, id, component, stray, strays, members, weight)."""
    parts = lambda n, w: F.ceil(F.greatest(n / BLOCK_MEMBERS, w / BLOCK_SHINGLES)).cast("int")
    m = (members.withColumn("km", F.greatest(F.lit(1), parts(F.col("members"), F.col("weight"))))
         .withColumn("ks", F.greatest(F.lit(1), parts(F.col("strays"), F.col("stray_weight"))))
         .withColumn("i", F.pmod(F.xxhash64("id"), "ks").cast("int"))
         .withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), "km").cast("int")))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = m.where("stray").select("key", "i", F.explode(span("km")).alias("j"), "id", "component", "stray")
    right = m.select("key", F.explode(span("ks")).alias("i"), "j", "id", "component", F.lit(False).alias("stray"))
    cells = left.unionByName(right).checkpoint()
    rows = cells.join(texts.of(cells.select("id")), "id")

    def compare(t: pa.Table) -> pa.Table:
        h, bounds = sets(*W.buffer(t["text"].combine_chunks()), k)
        n = np.diff(bounds)
        ids, comp = t["id"].to_numpy(), t["component"].to_numpy()
        stray = t["stray"].to_numpy(zero_copy_only=False).astype(bool)
        owner = np.repeat(np.arange(len(n)), n)
        _, code, count = np.unique(h, return_inverse=True, return_counts=True)
        shared = count > 1                              # others can't add to an intersection
        column = np.cumsum(shared) - 1
        use = shared[code]
        grid = np.zeros((len(n), int(shared.sum())), dtype=np.float32)
        grid[owner[use], column[code[use]]] = 1
        s, r = np.flatnonzero(stray), np.flatnonzero(~stray)
        both = np.rint(grid[s] @ grid[r].T).astype(np.int64)
        hit = (both > 0) & (100 * both >= percent * (n[s][:, None] + n[r][None, :] - both))
        hit &= comp[s][:, None] != comp[r][None, :]
        x, y = np.nonzero(hit)
        # one link for each stray and component
        _, one = np.unique(np.stack([s[x], comp[r[y]]]), axis=1, return_index=True)
        return pa.table({"a": pa.array(ids[s[x[one]]], pa.int64()), "b": pa.array(ids[r[y[one]]], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct().checkpoint()


def links(docs: DataFrame, signatures: DataFrame, k: int = SHINGLE, percent: int = MIN_PERCENT) -> DataFrame:
    """(a, b): confirmed links that connect all linked classes of ``docs`` (id,
    text) given their ``signatures`` (id, n, hi, lo, bands)."""
    texts = _Texts(docs)
    rep = (signatures.where("n > 0 and id is not null").groupBy("hi", "lo", "n")
           .agg(F.min("id").alias("id"), F.first("bands").alias("bands")))
    bands = rep.select("id", "n", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight")).where("members > 1")
    m = bands.join(shared, "key").checkpoint()
    degree = m.groupBy("id").agg(F.sum("members").alias("degree"))
    hubs = (m.join(degree, "id").groupBy("key")
            .agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "n")).alias("h"))
            .select("key", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n"))).checkpoint()
    star = (m.join(hubs, "key").where((F.col("id") != F.col("hub")) & _sizes_allow("n", "hub_n", percent))
            .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()).checkpoint()
    first = _confirm(star, texts, k, percent)

    comp = components(first)
    placed = (m.where("members > 2").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
              .join(hubs.join(comp.select(F.col("id").alias("hub"), F.col("component").alias("hub_component")),
                              "hub", "left")
                    .select("key", "hub", F.coalesce("hub_component", "hub").alias("hub_component")), "key")
              .withColumn("stray", F.col("component") != F.col("hub_component")))
    open_ = placed.groupBy("key").agg(F.count_if("stray").alias("strays"),
                                      F.sum(F.when(F.col("stray"), F.col("n")).otherwise(0)).alias("stray_weight")
                                      ).where("strays > 0")
    rest = placed.where(F.col("id") != F.col("hub")).join(open_, "key").checkpoint()

    small = rest.where(F.col("members") <= SMALL_BUCKET)
    x = small.where("stray").select("key", F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"))
    y = small.select("key", F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"))
    pairs = (x.join(y, "key").where((F.col("cx") != F.col("cy")) & _sizes_allow("nx", "ny", percent))
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
             .join(star, ["a", "b"], "left_anti"))
    second = _confirm(pairs, texts, k, percent)
    large = rest.where(F.col("members") > SMALL_BUCKET)
    third = _blocks(large, texts, k, percent)
    return first.unionByName(second).unionByName(third)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    percent: int = MIN_PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id
    reachable by links, itself included), kept (the id is its component's)."""
    checkpoint_dir(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    s = own.select("id", signature(F.col("text"), k, percent).alias("s")).select("id", "s.*").checkpoint()
    # a class is a star around its smallest id; ids that repeat with other texts join classes
    same = (s.where("n > 0 and id is not null").groupBy("hi", "lo", "n").agg(F.min("id").alias("rep")))
    copies = (s.where("n > 0 and id is not null").join(same, ["hi", "lo", "n"]).where("id <> rep")
              .select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comp = components(links(own, s, k, percent).unionByName(copies))
    out = s.join(comp, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, node): the whole row, and a number for its id and text.  It is the id itself,
    but for an id that repeats with other texts: all of these but one (the smallest digest)
    get a number of their own, from 2^62 on, by a hash of id and text."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("node"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    several = (rows.where("node is not null").groupBy("node").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
               .where("low <> high").select("node", "low").checkpoint())
    if several.head(1):
        seen = Bitmap(several, "node")
        rows = rows.withColumn("maybe", seen.might_have(F.col("node")))
        own = F.xxhash64("node", "digest").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        node = F.when(F.col("low").isNotNull() & (F.col("digest") != F.col("low")), own).otherwise(F.col("node"))
        more = rows.where("maybe").join(several, "node", "left").select("row", node.alias("node"))
        return rows.where("not maybe").select("row", "node").unionByName(more)
    return rows.select("row", "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
             percent: int = MIN_PERCENT) -> DataFrame:
    """The input's rows, all columns, one for each group of near duplicates (the smallest id's, where ids do not repeat).

    A row is judged by its own text: an id that repeats with unrelated texts keeps them all.  Of rows that
    repeat an id and its text one stays (rows without words, or without an id, all stay)."""
    checkpoint_dir(docs.sparkSession)
    rows = _nodes(docs, id_col, text_col)
    judged = (near_duplicates(rows.select("node", F.col(f"row.{text_col}").alias("text")), "node", "text", k, percent)
              .select(F.col("node").alias("drop_node"), "kept").checkpoint())
    dropped = judged.where("not kept").select("drop_node").distinct()
    repeated = judged.where("drop_node is not null").groupBy("drop_node").count().where("count > 1").select("drop_node")
    seen = Bitmap(dropped.unionByName(repeated), "drop_node")
    rows = rows.withColumn("maybe", F.col("node").isNotNull() & seen.might_have(F.col("node")))
    # only rows whose node may be dropped or repeated are shuffled
    left = rows.where("maybe").join(dropped, F.col("node") == F.col("drop_node"), "left_anti")
    one = F.coalesce(F.col(f"row.{text_col}").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # wordless rows all stay and are spread over many windows
    left = left.select("row", "node", one.alias("one"),
                       F.when(one, -1).otherwise(F.monotonically_increasing_id() % 4096).alias("salt"))
    w = Window.partitionBy("node", "salt").orderBy(F.xxhash64(f"row.{text_col}"))
    left = left.withColumn("nth", F.row_number().over(w)).where("nth = 1 or not one")
    return rows.where("not maybe").select("row.*").unionByName(left.select("row.*"))
