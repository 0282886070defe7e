"""Conversation repair: the cheapest edits that make roles alternate, the ASCII-least of them.

Kept roles must read ``(s?(ua)+)?`` by their initials.  Rows are kept (K, 0), get the role that is
due (R, 1) or are deleted (D, 2; required for blank and repeated ones); empty rows are inserted (I, 5); a truncated row that
stays costs 5 more.  Nodes are (place, state) with the states start, after system, after user, after assistant.

* Cost DP: cost to the end of every node, for all conversations of a batch at once.
* Prefix-doubling path ranking: the optimal arcs are ranked by the first 1, 2, 4, ... letters of
  the least audit that begins with them; an arc's pointer goes 2^k arcs on, and ranks and pointers of one
  length give those of twice the length.  (Letters of the arcs out of one node differ, so the first
  rank already fixes which arc follows.)  A conversation takes its start's arc of least rank, and the doubled
  pointers give all places of its path.

Rows are dealt by ranges of (conversation, turn, role, text) and sorted, so a long conversation
spreads over many tasks.  A conversation inside one task is solved there.  One at the edge of a task, or longer than
``PIECE_ROWS``, becomes pieces: each piece gives the least costs between its states on either side (in parallel), a
backward pass over these small matrices gives each piece the costs at its end, and a forward pass streams the
pieces in order.  Memory is bounded by pieces; only a conversation's own audit text is held as a whole, and its digest is
taken by the one task that streams it.

Defined results: null roles and texts are one space; null turns come first and do not count for
gaps; rows with equal turns are ordered by role, then text; null ids are one conversation; a conversation
without rows (all lost) has zeros, an empty audit and the digest of the empty text; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import checkpoint_dir

PIECE_ROWS = 4096               # a longer conversation is cut
PIECE_BYTES = 16 << 20
KEY_CHARS = 64                  # of role and text in the range bounds

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"

#: States 0 start, 1 after system, 2 after user, 3 after assistant.  ``DUE``: the state after the role that is due.
DUE = np.array([2, 2, 3, 2])
ROLE_DUE = ["user", "user", "assistant", "user"]
AT_END = np.array([0, 10, 5, 0], np.int64)      # cost of the inserts that are missing at the end
FAR = np.int64(1 << 50)
LETTERS = ["", "D", "I", "K", "R"]
D, I, K, R = 1, 2, 3, 4
_KIND = {"s": 0, "u": 1, "a": 2}
#: The state after a kept row, by state and initial (s, u, a, other); -1 where it may not be kept.
_KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])


def faults(roles: list[str], texts: list[str], seen: set) -> tuple[list[int], list[int]]:
    """(fault, kind) per row: fault 1 blank, 2 duplicate, 3 truncated, 0 none; kind of the role's
    initial.  ``seen`` holds the rows before and is added to."""
    fault, kind = [], []
    for r, x in zip(roles, texts):
        body = x.rstrip(SPACE)
        d = _digest(r, x)
        fault.append(1 if not body else 2 if d in seen else 0 if body[-1] in ENDS else 3)
        seen.add(d)
        kind.append(_KIND.get(r[:1], 3))
    return fault, kind


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _costs(fault: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keep, rerole, state after keep) by row and state; FAR where not allowed."""
    to = _KEEP[:, kind].T
    stay = np.where(fault == 3, 5, 0)[:, None] + np.where((fault == 1) | (fault == 2), FAR, 0)[:, None]
    return np.where(to >= 0, stay, FAR), np.broadcast_to(stay + 1, to.shape), np.maximum(to, 0)


def _before(after: np.ndarray, keep, rerole, to) -> np.ndarray:
    """Costs to the end before rows, from those after them (rows x 4; inserts come before the row)."""
    own = np.arange(len(after))[:, None]
    b = np.minimum(np.minimum(after + 2, rerole + after[:, DUE]), keep + after[own, to])
    one = b[:, DUE] + 5
    return np.minimum(np.minimum(b, one), b[:, DUE[DUE]] + 10)


def costs_to_end(fault: np.ndarray, kind: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs at every place: piece p has the rows first[p]:first[p + 1] and one place more than
    rows, from first[p] + p on; ``end`` (pieces x 4) are the costs at its last place."""
    n = np.diff(first)
    keep, rerole, to = _costs(fault, kind)
    order = np.argsort(-n, kind="stable")
    top = first[1:] + np.arange(len(n))             # the last place
    out = np.empty((len(fault) + len(n), 4), np.int64)
    out[top] = end
    for back in range(1, int(n.max(initial=0)) + 1):
        p = order[: np.searchsorted(-n[order], -back, side="right")]
        row = first[1:][p] - back
        out[top[p] - back] = np.minimum(_before(out[top[p] - back + 1], keep[row], rerole[row], to[row]), FAR)
    return out


def transfer(fault: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Least costs through a piece, 4 x 4: from the state before it to the state after it."""
    m = np.empty((4, 4), np.int64)
    for s in range(4):
        end = np.full((1, 4), FAR)
        end[0, s] = 0
        m[:, s] = costs_to_end(fault, kind, np.array([0, len(fault)]), end)[0]
    return m


def least_paths(fault: np.ndarray, kind: np.ndarray, first: np.ndarray, end: np.ndarray, last: np.ndarray,
                start: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(audit, cost) of each piece from state ``start``; ``last`` pieces insert what is missing at the end."""
    cost = costs_to_end(fault, kind, first, end)
    pieces, places = len(first) - 1, len(cost)
    piece = np.repeat(np.arange(pieces), np.diff(first) + 1)
    is_top = np.zeros(places, bool)
    is_top[first[1:] + np.arange(pieces)] = True
    state = np.broadcast_to(np.arange(4), (places, 4))
    here = 4 * np.arange(places)[:, None]
    # arcs by node (4 * place + state) and letter: cost and target
    keep, rerole, to = (np.zeros((places, 4), np.int64) for _ in range(3))
    keep[~is_top], rerole[~is_top], to[~is_top] = _costs(fault, kind)
    after = np.vstack((cost[1:], np.zeros((1, 4), np.int64)))
    own = np.arange(places)[:, None]
    fits = np.zeros((places, 4, 5), bool)
    fits[:, :, D] = after + 2 == cost
    fits[:, :, I] = cost[:, DUE] + 5 == cost
    fits[:, :, K] = (keep + after[own, to] == cost) & (keep < FAR)
    fits[:, :, R] = (rerole + after[:, DUE] == cost) & (rerole < FAR)
    missing = is_top & last[piece]
    fits[is_top] = False
    fits[missing, 1, I] = fits[missing, 2, I] = True
    fits[is_top, :, 0] = ~fits[is_top, :, I]
    target = np.stack([here + state, here + 4 + state, here + DUE[state], here + 4 + to, here + 4 + DUE[state]], axis=2)
    node, letter = np.nonzero(fits.reshape(-1, 5))
    target = target.reshape(-1, 5)[node, letter]
    # rank optimal arcs by audits of 1, 2, 4, ... letters; pointers skip as many arcs
    rank = letter
    pointer = np.searchsorted(node, target)         # the first arc of a node has the least letter
    pointers = []
    while True:
        pointers.append(pointer)
        done = letter[pointer] == 0
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[pointer], return_inverse=True)
        if done.all():
            break
        pointer = pointer[pointer]
    begin = 4 * (first[:-1] + np.arange(pieces)) + start
    best = np.lexsort((rank, node))
    at = best[np.searchsorted(node[best], begin)]
    # all places of the paths: sums of distinct powers of two steps
    of, step = np.arange(pieces), np.zeros(pieces, np.int64)
    for k in range(len(pointers) - 1, -1, -1):
        at, of, step = np.append(at, pointers[k][at]), np.append(of, of), np.append(step, step + (1 << k))
        real = letter[at] > 0
        at, of, step = at[real], of[real], step[real]
    order = np.lexsort((step, of))
    text = "".join(np.array(LETTERS)[letter[at[order]]].tolist())
    bounds = np.searchsorted(of[order], np.arange(pieces + 1)).tolist()
    return [text[i:j] for i, j in zip(bounds, bounds[1:])], cost[first[:-1] + np.arange(pieces), start]


def apply(audit: str, roles: list[str], texts: list[str], state: int = 0) -> tuple[list[tuple[str, str]], int]:
    """The rows that the edits leave, and the state after them."""
    out, i = [], 0
    for c in audit:
        if c == "I":
            out.append((ROLE_DUE[state], ""))
            state = int(DUE[state])
            continue
        if c == "K":
            out.append((roles[i], texts[i]))
            state = int(_KEEP[state, _KIND[roles[i][:1]]])
        elif c == "R":
            out.append((ROLE_DUE[state], texts[i]))
            state = int(DUE[state])
        i += 1
    return out, state


@dataclass
class Counts:
    """What is counted along a conversation, piece by piece."""
    low: int | None = None
    high: int | None = None
    turns: int = 0
    initial: str | None = None
    n: list[int] = field(default_factory=lambda: [0, 0, 0, 0])     # -, blank, duplicate, truncated
    illegal: int = 0

    def add(self, turns: list, roles: list[str], fault: list[int]) -> None:
        for t in turns:                             # ascending, nulls first
            if t is not None and t != self.high:
                self.low = t if self.low is None else self.low
                self.high, self.turns = t, self.turns + 1
        for r in roles:
            if self.initial is not None:
                self.illegal += self.initial + r[:1] not in ("su", "ua", "au")
            self.initial = r[:1]
        for f in fault:
            self.n[f] += 1

    def row(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *self.n[1:], self.illegal]


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PIECE = [("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
          ("digests", pa.list_(pa.binary()))]
_DDL = ", ".join(["edge boolean, part int, seq bigint", *[f"{c} bigint" for c in REPORT], "audit string, repaired_sha256 string",
                  "repaired array<struct<role:string,text:string>>"])
_PIECE_DDL = "turns array<bigint>, roles array<string>, texts array<string>, digests array<binary>"


def _table(ids: list, id_type: pa.DataType, rows: list[dict], more: list) -> pa.RecordBatch:
    fields = [("edge", pa.bool_()), ("part", pa.int32()), ("seq", pa.int64()), *[(c, pa.int64()) for c in REPORT],
              ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", _REPAIRED), *more]
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array([r.get(n) for r in rows], t) for n, t in fields]],
                                      names=["id", *[n for n, _ in fields]])


def _sha(rows: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{x}" for r, x in rows).encode()).hexdigest()


def _solve(group: list[dict]) -> list[dict]:
    """Reports of whole conversations."""
    first, fault, kind, counts = [0], [], [], []
    for g in group:
        f, k = faults(g["roles"], g["texts"], set())
        c = Counts()
        c.add(g["turns"], g["roles"], f)
        counts.append(c)
        fault += f
        kind += k
        first.append(len(fault))
    n = len(group)
    audits, cost = least_paths(np.array(fault, np.int64), np.array(kind, np.int64), np.array(first), np.tile(AT_END, (n, 1)),
                               np.ones(n, bool), np.zeros(n, np.int64))
    out = []
    for g, c, a, x in zip(group, counts, audits, cost.tolist()):
        rows, _ = apply(a, g["roles"], g["texts"])
        out.append(dict(zip(REPORT, [*c.row(), x]), edge=False, audit=a, repaired_sha256=_sha(rows),
                        repaired=[{"role": r, "text": t} for r, t in rows]))
    return out


def _conversations(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task: solved conversations, and pieces of those that may go on elsewhere."""
    part = TaskContext.get().partitionId()
    seq, first, cut, size = 0, True, False, 0
    now: dict | None = None

    def piece(g: dict) -> dict:
        nonlocal seq
        seq += 1
        digests = sorted({_digest(r, x) for r, x in zip(g["roles"], g["texts"])})
        return g | {"edge": True, "part": part, "seq": seq, "digests": digests}

    id_type = None
    for b in batches:
        id_type = b.column(0).type
        whole, pieces = [], []
        for i, t, r, x, lost in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or now["id"] != i:
                if now is not None:
                    (pieces if first or cut else whole).append(piece(now) if first or cut else now)
                    first = False
                now, cut, size = {"id": i, "turns": [], "roles": [], "texts": []}, False, 0
            elif len(now["roles"]) >= piece_rows or size >= PIECE_BYTES:
                pieces.append(piece(now))
                now, cut, size = {"id": i, "turns": [], "roles": [], "texts": []}, True, 0
            if not lost:
                now["turns"].append(t)
                now["roles"].append(r)
                now["texts"].append(x)
                size += len(x)
        solved = _solve(whole)
        yield _table([g["id"] for g in whole + pieces], id_type, solved + pieces, _PIECE)
    if now is not None:
        yield _table([now["id"]], id_type, [piece(now)], _PIECE)


def _matrix(roles: Column, texts: Column, seen: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def matrix(r: pa.Array, x: pa.Array, s: pa.Array) -> pa.Array:
        out = []
        for roles, texts, before in zip(r.to_pylist(), x.to_pylist(), s.to_pylist()):
            f, k = faults(roles, texts, set(before or []))
            out.append(transfer(np.array(f, np.int64), np.array(k, np.int64)).ravel().tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return matrix(roles, texts, seen)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from the last to the first: the costs at each piece's end."""
    now, cost = object(), AT_END
    for b in batches:
        ids, parts, seqs, ms = (c.to_pylist() for c in b.columns)
        ends, last = [], []
        for i, m in zip(ids, ms):
            last.append(i != now)
            if i != now:
                now, cost = i, AT_END
            ends.append(cost.tolist())
            cost = np.minimum((np.array(m).reshape(4, 4) + cost).min(axis=1), FAR)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(seqs, pa.int64()), pa.array(ends, pa.list_(pa.int64())),
                                          pa.array(last, pa.bool_())], names=["part", "seq", "end", "last"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order: edits and repaired rows of each, and the report with the last one."""
    now, state, counts, cost, audit, sha, any_row = object(), 0, Counts(), 0, [], hashlib.sha256(), False
    for b in batches:
        out = []
        ids = b.column(0).to_pylist()
        for i, part, seq, turns, roles, texts, seen, end, last in zip(*(c.to_pylist() for c in b.columns)):
            new = i != now
            if new:
                now, state, counts, audit, sha, any_row = i, 0, Counts(), [], hashlib.sha256(), False
            f, k = faults(roles, texts, set(seen or []))
            counts.add(turns, roles, f)
            letters, c = least_paths(np.array(f, np.int64), np.array(k, np.int64), np.array([0, len(f)]), np.array([end]),
                                     np.array([last]), np.array([state]))
            cost = int(c[0]) if new else cost
            rows, state = apply(letters[0], roles, texts, state)
            audit.append(letters[0])
            for r, x in rows:
                sha.update((b"\n" if any_row else b"") + f"{r}:{x}".encode())
                any_row = True
            row = {"edge": last, "part": part, "seq": seq, "repaired": [{"role": r, "text": x} for r, x in rows]}
            if last:
                row |= dict(zip(REPORT, [*counts.row(), cost]), audit="".join(audit), repaired_sha256=sha.hexdigest())
            out.append(row)
        yield _table(ids, b.column(0).type, out, [])


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


@dataclass
class Repair:
    #: One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    report: DataFrame
    #: The repaired rows: id, part, seq, pos (their order), role, text.
    turns: DataFrame


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           lost: Column | None = None, piece_rows: int = PIECE_ROWS) -> Repair:
    """Repair all conversations of ``rows``; rows where ``lost`` holds count for the existence of their conversation only."""
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/conversation-repair-{uuid.uuid4().hex}"
    lost = F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))
    s = rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), lost.alias("lost"))
    head = [F.substring(F.col(c), 1, KEY_CHARS) for c in ("role", "text")]
    s = s.repartitionByRange("id", "turn", *head).sortWithinPartitions("id", "turn", "role", "text")
    kind = T.StructType([s.schema["id"]])
    more = lambda ddl: T.StructType(kind.fields + T.StructType.fromDDL(ddl).fields)
    first = _written(s.mapInArrow(partial(_conversations, piece_rows=piece_rows), more(f"{_DDL}, {_PIECE_DDL}")), folder, "conversations")
    columns = ["id", *REPORT, "audit", "repaired_sha256"]
    whole, pieces = first.where("not edge"), first.where("edge").select("id", "part", "seq", "turns", "roles", "texts", "digests")

    # rows of a piece that earlier pieces of the conversation have too (one digest a piece)
    digests = pieces.select("id", F.struct("part", "seq").alias("at"), F.explode("digests").alias("digest"))
    earliest = digests.groupBy("id", "digest").agg(F.min("at").alias("first"))
    seen = (digests.alias("d").join(earliest.alias("e"), F.col("d.id").eqNullSafe(F.col("e.id")) & (F.col("d.digest") == F.col("e.digest")))
            .where("d.at > e.first").groupBy(F.col("d.at.part").alias("part"), F.col("d.at.seq").alias("seq"))
            .agg(F.collect_list("d.digest").alias("seen")))
    pieces = pieces.drop("digests").join(seen, ["part", "seq"], "left").select("id", "part", "seq", "turns", "roles", "texts", "seen")
    matrices = pieces.select("id", "part", "seq", _matrix(F.col("roles"), F.col("texts"), F.col("seen")).alias("m"))
    ends = (matrices.repartition("id").sortWithinPartitions("id", F.col("part").desc(), F.col("seq").desc())
            .mapInArrow(_backward, "part int, seq bigint, end array<bigint>, last boolean"))
    ordered = pieces.join(ends, ["part", "seq"]).select("id", "part", "seq", "turns", "roles", "texts", "seen", "end", "last")
    second = _written(ordered.repartition("id").sortWithinPartitions("id", "part", "seq").mapInArrow(_forward, more(_DDL)), folder, "pieces")
    report = whole.select(columns).unionByName(second.where("edge").select(columns))
    every = whole.select("id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), "repaired").unionByName(
        second.select("id", "part", "seq", "repaired"))
    turns = every.select("id", "part", "seq", F.posexplode("repaired").alias("pos", "r")).select("id", "part", "seq", "pos", "r.role", "r.text")
    return Repair(report.withColumnRenamed("id", id_col), turns.withColumnRenamed("id", id_col))


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of op12's contract: (conv_id, turn, role, text, lost), nulls as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    d = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), (F.col("kind") == 0).alias("lost"), copies.alias("copy")).drop("copy")
