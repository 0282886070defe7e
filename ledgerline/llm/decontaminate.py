"""Benchmark decontamination as a prefix-filtered set join.

The sets are shingles (5 words; a shorter window is its own shingle).  A
window (13 consecutive words of an item, or a whole shorter item) occurs in a
text only if all its shingles do, so for exact containment one necessary
shingle, the prefix, is enough to find it:

1. one pass over the texts keeps the runs of words whose shingles are in a
   fixed-size bitmap of the benchmark's shingles (others can't be hit);
2. shingles are ordered by rarity in these runs, and each distinct window joins
   the texts on its rarest one only; a window with a shingle that occurs
   nowhere is dropped;
3. the place of the shingle in the window fixes where the window would start;
   start and length must fit the run (positional and length bounds);
4. the words at that place are compared with the window's, word by word.

Texts with equal bytes are searched once.  Nothing is broadcast but the bitmap; the joins are
equi-joins whose benchmark side has one row per shingle and window.

Defined results: a null or word-less text has no words and no hits; a
word-less item has no window; rows that repeat an item or document change nothing for others, and
every document row is returned; a null item id counts as the empty string; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import words as W
from ledgerline.llm.bitmap import Bitmap, lookup
from ledgerline.session import checkpoint_dir

WINDOW = 13
SHINGLE = 5
MIN_SHARE = 20          # contaminated: at least one word in so many is hit

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if W.ALNUM.keep[b] else 32 for b in range(256))


def _texts(raw: bytes) -> list[str]:
    return [x.decode() for x in raw.translate(_FOLD).split(b" ") if x]


def item_words(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([_texts((t.as_py() or "").encode()) for t in texts], pa.list_(pa.string()))

    return cut(text)


def _item_keys(text: Column, k: int) -> Column:
    """Fingerprints of an item's shingles."""
    @F.arrow_udf("array<bigint>")
    def keys(texts: pa.Array) -> pa.Array:
        out = []
        for data, off, _, _ in W.chunks(texts):
            h, doc, _ = W.shingles(W.split(data, off, W.ALNUM), k)
            at = np.searchsorted(doc, np.arange(len(off)))
            out += [h[a:b].view(np.int64) for a, b in zip(at[:-1], at[1:])]
        return pa.array(out, pa.list_(pa.int64()))

    return keys(text)


_RUN = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.list_(pa.string()))]))


def _runs(text: Column, known: Bitmap, lengths: tuple[int, ...]) -> Column:
    """struct<n_words, runs>: word count, and the maximal runs of words covered
    by shingles (of the given lengths) that may be in the bitmap."""
    table, log2_bits = known.table, known.log2_bits

    @F.arrow_udf("struct<n_words:bigint,runs:array<struct<start:int,words:array<string>>>>")
    def find(texts: pa.Array) -> pa.Array:
        n_words, runs = [], []
        for data, off, _, _ in W.chunks(texts):
            w = W.split(data, off, W.ALNUM)
            n, doc = len(w.hashes), w.doc
            n_words.append(w.counts)
            of: list[list] = [[] for _ in range(len(off) - 1)]
            runs += of
            inside = np.zeros(n, dtype=bool)
            for k in lengths:
                h, _, pos = W.shingles(w, k)
                full = pos + k <= w.first[doc[pos] + 1]
                at = pos[full][lookup(table.value, h[full], log2_bits)]
                inside |= W.covered(n, at, k)
            if not inside.any():
                continue
            before = np.concatenate(([False], inside[:-1] & (doc[1:] == doc[:-1])))
            after = np.concatenate((inside[1:] & (doc[1:] == doc[:-1]), [False]))
            raw = data.tobytes()
            stop = np.append(w.starts, len(raw))
            for a, b in zip(np.flatnonzero(inside & ~before).tolist(), np.flatnonzero(inside & ~after).tolist()):
                d = int(doc[a])
                end = min(int(stop[b + 1]), int(off[d + 1]))
                of[d].append({"start": a - int(w.first[d]), "words": _texts(raw[int(stop[a]): end])})
        n_all = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(n_all, pa.int64()), pa.array(runs, _RUN)], ["n_words", "runs"])

    return find(text)


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(item, win, size): the distinct windows of each item, words joined with spaces."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                     item_words(F.col(text_col)).alias("words")).where("size(words) > 0")
    win = F.expr(f"transform(sequence(0, greatest(0, size(words) - {width})), "
                 f"i -> array_join(slice(words, i + 1, {width}), ' '))")
    return w.select("item", F.least(F.size("words"), F.lit(width)).alias("size"), F.explode(win).alias("win")).distinct()


def _pieces(words: str, k: str) -> Column:
    return F.expr(f"transform(sequence(0, size({words}) - {k}), i -> array_join(slice({words}, i + 1, {k}), ' '))")


def _hit_words(spans: str) -> Column:
    """Number of positions inside the spans (structs of s, size), sorted here."""
    return F.expr(f"""aggregate(array_sort({spans}), named_struct('n', 0L, 'upto', 0),
        (a, x) -> named_struct('n', a.n + greatest(0, x.s + x.size - greatest(a.upto, x.s)),
                               'upto', greatest(a.upto, x.s + x.size)), a -> a.n)""")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text",
           width: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """One row per document row: id, n_words, n_hit, item ids (sorted) and spans of hit words."""
    checkpoint_dir(docs.sparkSession)
    iw = windows(items, item_col, item_text_col, width).checkpoint()
    # at most k - 1 lengths below k
    lengths = tuple(sorted({k} | {r[0] for r in iw.where(F.col("size") < k).select("size").distinct().collect()}))
    keys = items.select(F.explode(_item_keys(F.col(item_text_col), k)).alias("key"))
    found = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col))).alias("key"),
                        _runs(F.col(text_col), Bitmap(keys, "key"), lengths).alias("f"))
    found = found.select("id", "key", "f.*").checkpoint()
    runs = (found.where("size(runs) > 0").dropDuplicates(["key"])
            .select("key", F.explode("runs").alias("r")).select("key", "r.start", "r.words")).checkpoint()

    w = iw.select("win", "size").distinct().withColumn("words", F.split("win", " "))
    pieces = w.select("win", "size", F.posexplode(_pieces("words", f"least({k}, size(words))")).alias("o", "piece"))
    places = None
    for n in lengths:
        p = (runs.where(F.size("words") >= n)
             .select("key", "start", F.size("words").alias("run"), F.posexplode(_pieces("words", str(n))).alias("p", "piece")))
        places = p if places is None else places.unionByName(p)
    rarity = places.groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    prefix = (pieces.join(rarity, "piece", "left").groupBy("win", "size")
              .agg(F.count_if(F.col("df").isNull()).alias("missing"),
                   F.min(F.struct("df", "piece", "o")).alias("rarest"))
              .where("missing = 0").select("win", "size", "rarest.piece", "rarest.o"))
    start = F.col("p") - F.col("o")
    candidates = (places.join(prefix, "piece")
                  .where((start >= 0) & (start + F.col("size") <= F.col("run")))
                  .groupBy("key", "start").agg(F.collect_list(F.struct(start.alias("s"), "size", "win")).alias("c")))
    exact = F.expr("filter(c, x -> array_join(slice(words, x.s + 1, x.size), ' ') = x.win)")
    hits = (candidates.join(runs, ["key", "start"]).select("key", "start", exact.alias("c"))
            .where("size(c) > 0")).checkpoint()
    words_hit = (hits.select("key", _hit_words("transform(c, x -> named_struct('s', x.s, 'size', x.size))").alias("n"),
                             F.expr("transform(c, x -> named_struct('start', start + x.s, 'end', start + x.s + x.size))").alias("at"))
                 .groupBy("key").agg(F.sum("n").alias("n_hit"), F.array_sort(F.flatten(F.collect_list("at"))).alias("spans")))
    by_item = (hits.select("key", F.explode(F.expr("array_distinct(transform(c, x -> x.win))")).alias("win")).distinct()
               .join(iw.select("win", "item"), "win").select("key", "item").distinct()
               .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    got = words_hit.join(by_item, "key")
    empty = found.where("size(runs) = 0").select(
        "id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"))
    some = found.where("size(runs) > 0").join(got, "key", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "items", "spans")
    return empty.unionByName(some).select(F.col("id").alias(id_col), "n_words", "n_hit",
                                          F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def contaminated(n_hit: Column, n_words: Column, min_share: int = MIN_SHARE) -> Column:
    return (n_hit > 0) & (min_share * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """The input's rows, all columns, without those whose text is contaminated.

    A text is named by its digest; a bitmap of the contaminated ones' digests
    lets all other rows through without a shuffle."""
    text = F.col(text_col)
    own = docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    bad = (search(own, items, "key", "text", item_col, item_text_col)
           .where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("key").alias("bad_key")).distinct()).checkpoint()
    seen = Bitmap(bad.select(F.xxhash64("bad_key").alias("k")), "k")
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(text)).alias("key"))
    rows = rows.withColumn("maybe", F.col("key").isNotNull() & seen.might_have(F.xxhash64("key")))
    left = rows.where("maybe").join(bad, F.col("key") == F.col("bad_key"), "left_anti")
    return rows.where("not maybe").select("row.*").unionByName(left.select("row.*"))
