"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of all orders up to ``ORDER``:

    P_k(w | h) = l_k(b) * c(h w) / c(h) + (1 - l_k(b)) * P_{k-1}(w | shorter h)

down to 1 / (V + 1), with one weight l_k(b) for each order and bucket b of the
context's frequency (powers of two).  The weights are learned by
expectation-maximisation on a deleted fold of the training texts: its
n-grams are subtracted from the counts, and the rest must predict them.

How the counts meet the texts.  Texts are packed into blocks of about
``BLOCK_BYTES``.  A block sends each distinct n-gram once, as a sorted key list for each
range of keys, to the task that owns the range; that task adds the counts of all
blocks and answers each list with totals in the same order, without the keys.  So what
is shuffled grows with the distinct n-grams of the blocks (a hot word is one
key per block), and no table of the corpus is held in one place.  Texts of the deleted fold have
blocks of their own, and only these are read for EM.  EM runs on the held-out
events summed in cells of a fixed grid (bucket and probabilities in eighths of an octave),
whose size doesn't grow with the corpus.

Defined results: a null or word-less text is its end token alone; a null id is hashed as empty text; rows
that repeat count and are scored each; with no training text every count is 0; other columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.llm import words as W
from ledgerline.session import checkpoint_dir

ORDER = 2
FOLDS, HELD_OUT, DELETED = 7, 2, 3      # crc32(id) mod FOLDS: never learned from / deleted for EM
BLOCK_BYTES = 14 << 20
RANGE_KEYS = 1 << 21                    # n-gram keys that one task adds up, about
BUCKETS = 24
EM_ROUNDS = 100
_BEGIN, _END = W.random_words(41, 2)
_STEP = W.random_words(42, 8) | W.U64(1)
_LOW = 2                                # low bits of a key that hold its order; 62 bits are left for the n-gram
_NONE = -32768                          # grid value of probability 0


def fold(id_: Column) -> Column:
    return (F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


class Block:
    """Tokens of a block's texts, and the keys of their n-grams."""

    def __init__(self, texts: pa.Array, order: int):
        hashes, counts = [], []
        for data, off, _, _ in W.chunks(texts):
            w = W.split(data, off, W.SPACED)
            hashes.append(w.hashes)
            counts.append(w.counts)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.n_tokens = n + 1
        self.ends = np.cumsum(self.n_tokens)
        self.starts = self.ends - self.n_tokens
        total = int(self.n_tokens.sum())
        token = np.empty(total, W.U64)
        word = np.ones(total, bool)
        word[self.ends - 1] = False
        token[word] = np.concatenate(hashes) if hashes else np.zeros(0, W.U64)
        token[~word] = _END
        # an n-gram's key: order in the last two bits
        self.keys, run, before = [], token.copy(), token
        for k in range(order):
            if k:
                before = np.concatenate(([_BEGIN], before[:-1])) if total else before
                before[self.starts] = _BEGIN
                run = W.mix(run + before * _STEP[k])
            self.keys.append((W.mix(run) & ~W.U64((1 << _LOW) - 1)) | W.U64(k))

    def rows(self, docs: np.ndarray) -> np.ndarray:
        """Mask over tokens of the texts in the mask ``docs``."""
        return np.repeat(docs, self.n_tokens)

    def distinct(self) -> np.ndarray:
        return np.unique(np.concatenate(self.keys)) if self.keys else np.zeros(0, W.U64)

    def counts(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """How often each of the sorted ``keys`` occurs in the texts of the mask."""
        out = np.zeros(len(keys), np.int64)
        mask = self.rows(docs)
        got, n = np.unique(np.concatenate([k[mask] for k in self.keys]), return_counts=True)
        out[np.searchsorted(keys, got)] = n
        return out

    def all_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct keys, and how often each occurs."""
        return np.unique(np.concatenate(self.keys), return_counts=True)


def _zip(x: np.ndarray) -> bytes:
    """Integers as bytes: all lowest bytes first, then the next ones, compressed."""
    size = x.dtype.itemsize
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, size).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unzip(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    planes = pa.decompress(b[8:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(dtype).reshape(n)


def _zip_keys(keys: np.ndarray, order: int) -> list[bytes]:
    """Sorted keys as differences, each order on its own."""
    own = [keys[(keys & W.U64(3)) == k] >> W.U64(_LOW) for k in range(order)]
    return [_zip(np.diff(x, prepend=W.U64(0))) for x in own]


def _unzip_keys(parts) -> np.ndarray:
    own = [np.cumsum(_unzip(b, np.uint64), dtype=W.U64) << W.U64(_LOW) | W.U64(k) for k, b in enumerate(parts)]
    return np.sort(np.concatenate(own))


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts; those of the deleted fold (``gone``) have blocks of their own."""
    part, nth = TaskContext.get().partitionId(), 0
    held: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}
    schema = pa.schema([("block", pa.int64()), ("gone", pa.bool_()), ("docs", pa.binary())])

    def block(gone):
        nonlocal nth
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(held[gone]).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        nth, held[gone], size[gone] = nth + 1, [], 0
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) | (nth - 1)], pa.int64()), pa.array([gone], pa.bool_()),
                                           pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema)

    for batch in batches:
        deleted = pa.compute.equal(batch.column("fold"), DELETED)
        for gone, own in ((True, batch.filter(deleted)), (False, batch.filter(pa.compute.invert(deleted)))):
            at, rows = 0, own.num_rows
            _, off = W.buffer(own.column("text"))
            while at < rows:
                upto = max(at + 1, int(np.searchsorted(off, off[at] + limit - size[gone], side="right")) - 1)
                held[gone].append(own.slice(at, upto - at))
                size[gone] += int(off[upto] - off[at])
                at = upto
                if size[gone] >= limit or at < rows:
                    yield block(gone)
    for gone in held:
        if held[gone]:
            yield block(gone)


def _unpack(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def _learned(folds: np.ndarray) -> np.ndarray:
    return folds != HELD_OUT


_SENT = "block bigint, gone boolean, range int, keys array<binary>, n binary"
_ANSWERS = "block bigint, gone boolean, range int, train binary, deleted binary, sums array<bigint>"


def _send(batches, order: int, log2_ranges: int):
    """Per block and range of keys: the sorted keys (as differences), and their counts in the
    block's training texts (a ``gone`` block's are all deleted ones)."""
    schema = pa.schema([("block", pa.int64()), ("gone", pa.bool_()), ("range", pa.int32()), ("keys", pa.list_(pa.binary())),
                        ("n", pa.binary())])
    for batch in batches:
        for i, gone, raw in zip(batch.column("block").to_pylist(), batch.column("gone").to_pylist(), batch.column("docs")):
            t = _unpack(raw.as_py())
            b = Block(t["text"].combine_chunks(), order)
            keys, n = b.all_counts()
            if not gone:
                n = n - b.counts(keys, ~_learned(t["fold"].to_numpy()))
            edges = np.searchsorted(keys, np.arange(1, 1 << log2_ranges, dtype=W.U64) << W.U64(64 - log2_ranges)) \
                if log2_ranges else np.zeros(0, np.int64)
            cut = np.concatenate(([0], edges, [len(keys)]))
            out = [(i, gone, r, _zip_keys(keys[a:z], order), _zip(n[a:z]))
                   for r, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _add(t: pa.Table) -> pa.Table:
    """Totals of a range, for every block's list (deleted ones only where they are read, for
    ``gone`` blocks); the range's own sums are in one row of block -1."""
    keys = [_unzip_keys(x.as_py()) for x in t["keys"]]
    every = np.unique(np.concatenate(keys))
    train, deleted = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    at = [np.searchsorted(every, k) for k in keys]
    gone = t["gone"].to_pylist()
    for a, g, x in zip(at, gone, t["n"]):
        n = _unzip(x.as_py(), np.int64)
        train[a] += n
        if g:
            deleted[a] += n
    one = (every & W.U64(3)) == 0
    sums = [int(x) for x in (train[one].sum(), (train[one] > 0).sum(), deleted[one].sum(), ((train - deleted)[one] > 0).sum())]
    rows = [(b, g, _zip(train[a]), _zip(deleted[a]) if g else None, None) for b, g, a in zip(t["block"].to_pylist(), gone, at)]
    rows.append((-1, False, None, None, sums))
    block, gone, train_, deleted_, sums_ = zip(*rows)
    return pa.table({"block": pa.array(block, pa.int64()), "gone": pa.array(gone, pa.bool_()),
                     "range": pa.array([t["range"][0].as_py()] * len(rows), pa.int32()), "train": pa.array(train_, pa.binary()),
                     "deleted": pa.array(deleted_, pa.binary()), "sums": pa.array(sums_, pa.list_(pa.int64()))})


def _totals(answers: pa.Table, column: str) -> np.ndarray:
    """A block's totals in the order of its keys."""
    return np.concatenate([_unzip(x.as_py(), np.int64) for x in answers.sort_by("range")[column]])


def _estimates(b: Block, keys: np.ndarray, totals: np.ndarray, mask: np.ndarray | slice, n_all: int, n_docs: int):
    """For the tokens of the mask, by order: (c(h w), c(h))."""
    found = [totals[np.searchsorted(keys, k)] for k in b.keys]
    out = [(found[0][mask], np.full(len(found[0][mask]), n_all, np.int64))]
    for k in range(1, len(b.keys)):
        context = np.concatenate(([0], found[k - 1][:-1]))
        context[b.starts] = n_docs              # nothing but begins
        out.append((found[k][mask], context[mask]))
    return out


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + its power of two."""
    b = np.zeros(len(context), np.int64)
    seen = context > 0
    b[seen] = np.minimum(1 + np.log2(context[seen]).astype(np.int64), BUCKETS - 1)
    return b


def _ratio(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, c / np.maximum(n, 1), 0.0)


def _cells(blocks: pa.Table, answers: pa.Table, order: int, n_all: int, n_docs: int) -> pa.Table:
    """Held-out events of a block of the deleted fold, summed in grid cells."""
    b = Block(_unpack(blocks["docs"][0].as_py())["text"].combine_chunks(), order)
    rest = _totals(answers, "train") - _totals(answers, "deleted")
    cols = []
    for c, n in _estimates(b, b.distinct(), rest, slice(None), n_all, n_docs):
        p = _ratio(c, n)
        q = np.full(len(p), _NONE, np.int64)
        q[p > 0] = np.rint(8 * np.log2(p[p > 0])).astype(np.int64)
        cols += [_bucket(n), q]
    # one number per event: faster to count than rows
    spread = [(int(c.min()), int(c.max() - c.min()) + 1) for c in cols]
    code = np.zeros(len(cols[0]), np.int64)
    for c, (low, width) in zip(cols, spread):
        code = code * width + (c - low)
    code, n = np.unique(code, return_counts=True)
    cell = []
    for low, width in reversed(spread):
        cell.append((code % width + low).astype(np.int32))
        code = code // width
    return pa.table({"cell": pa.array(np.stack(cell[::-1], axis=1).tolist(), pa.list_(pa.int32())), "n": pa.array(n, pa.int64())})


def learn(cells: np.ndarray, weight: np.ndarray, order: int, n_words: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Mixture weights [order, bucket] by EM on held-out events."""
    lam = np.full((order, BUCKETS), 0.5)
    lam[:, 0] = 0.0
    if not len(cells):
        return lam
    bucket, p = cells[:, 0::2], np.where(cells[:, 1::2] == _NONE, 0.0, 2.0 ** (cells[:, 1::2] / 8.0))
    for _ in range(rounds):
        total, share = np.full(len(cells), 1.0 / (n_words + 1)), []
        for k in range(order):
            own = lam[k][bucket[:, k]] * p[:, k]
            total = own + (1 - lam[k][bucket[:, k]]) * total
            share.append(own / total)
        new, reach = lam.copy(), weight.astype(float)
        for k in range(order - 1, -1, -1):
            num = np.bincount(bucket[:, k], reach * share[k], BUCKETS)
            den = np.bincount(bucket[:, k], reach, BUCKETS)
            new[k] = (num + 0.5) / (den + 1.0)
            reach = reach * (1 - share[k])
        new[:, 0] = 0.0
        done = np.abs(new - lam).max() < 1e-7
        lam = new
        if done:
            break
    return lam


def _scores(blocks: pa.Table, answers: pa.Table, order: int, n_all: int, n_words: int, n_docs: int, lam: np.ndarray,
            id_type: pa.DataType) -> pa.Table:
    """The rows of a block, scored."""
    t = _unpack(blocks["docs"][0].as_py())
    b = Block(t["text"].combine_chunks(), order)
    est = _estimates(b, b.distinct(), _totals(answers, "train"), slice(None), n_all, n_docs)
    c = est[0][0]
    p = np.full(len(c), 1.0 / (n_words + 1))
    for k, (own, n) in enumerate(est):
        w = lam[k][_bucket(n)]
        p = w * _ratio(own, n) + (1 - w) * p
    each = lambda x: np.add.reduceat(x, b.starts)
    return pa.table({"id": t["id"].combine_chunks().cast(id_type), "held_out": pa.array(t["fold"].to_numpy() == HELD_OUT),
                     "n_tokens": pa.array(b.n_tokens, pa.int64()), "n_known": pa.array(each((c > 0).astype(np.int64)), pa.int64()),
                     "train_tokens": pa.array(np.full(len(t), n_all), pa.int64()),
                     "base_score": pa.array(each(np.log10((c + 1) / (n_all + 1.0 * (n_words + 1)))), pa.float64()),
                     "score": pa.array(each(np.log10(p)), pa.float64())})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    checkpoint_dir(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), fold(F.col(id_col)).alias("fold"))
    blocks = own.mapInArrow(lambda x: _pack(x, block_bytes), "block bigint, gone boolean, docs binary").checkpoint()
    folds = {r[0]: r[1] for r in own.groupBy("fold").agg(F.count(F.lit(1))).collect()}       # at most FOLDS rows
    n_docs = sum(n for f, n in folds.items() if f != HELD_OUT)
    n_rest = n_docs - folds.get(DELETED, 0)
    # about one distinct n-gram of each order for every 10 bytes
    size = blocks.count() * block_bytes * order // 10
    log2_ranges = max(0, int(np.ceil(np.log2(max(1, size / RANGE_KEYS)))))
    sent = blocks.mapInArrow(lambda x: _send(x, order, log2_ranges), _SENT)
    answers = sent.groupBy("range").applyInArrow(_add, _ANSWERS).checkpoint()
    del sent
    _release(docs)
    sums = answers.where("block = -1").agg(*[F.sum(F.col("sums")[i]) for i in range(4)]).first()
    n_all, n_words, n_gone, n_left = (x or 0 for x in sums)
    answers = answers.where("block >= 0")

    def meet(only: str, column: list[str], use, ddl: str) -> DataFrame:
        """``use(block, its answers)`` for the blocks that ``only`` selects."""
        mine = answers.where(only).select("block", "range", *column)
        return blocks.where(only).select("block", "docs").groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(use, ddl)

    cells = meet("gone", ["train", "deleted"], lambda b, a: _cells(b, a, order, n_all - n_gone, n_rest), "cell array<int>, n bigint")
    grid = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()                      # bounded by the grid
    lam = learn(np.array(grid["cell"].tolist(), dtype=np.int64), grid["n"].to_numpy(), order, n_left)
    _release(docs)
    kind = own.schema["id"].dataType
    ddl = (f"id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, "
           "train_tokens bigint, base_score double, score double")
    id_type = to_arrow_type(kind)
    return meet("true", ["train"], lambda b, a: _scores(b, a, order, n_all, n_words, n_docs, lam, id_type), ddl).withColumnRenamed("id", id_col)


def _release(df: DataFrame) -> None:
    """Let Spark remove the shuffle files and checkpoints of finished steps:
    its cleaner does so when the driver has collected their handles."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
