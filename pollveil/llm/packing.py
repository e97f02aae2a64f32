"""Mixture-controlled packing: deficit round-robin over source queues.

Documents of a source form a queue. Queues are served one quantum of QUANTUM tokens at a time, the windows' length being
a multiple of it, so that a window is a few long stretches and not a sliver of every source. A queue earns its target
share of every quantum that is served; what it was due so far less what it got is its deficit, which is carried over
windows and partitions, so that windows keep the target proportions over time and a small source is served in every k-th
window. Deficits live in a binary tree of queues (`Tree`): at each node two sides share what the node is served, the left
one taking a turn whenever its deficit, plus its share of one turn, reaches one quantum. A queue is therefore never more
than half a quantum ahead or behind at a node, and log2(queues) / 2 quanta in all. Turns have a closed form, so that any
task can take up the round-robin at any document: nothing runs through one task.

What a source has beyond whole quanta (under one quantum), and sources too small for a queue of their own, form one more
queue in the order of their names; it is served like any other. So each source keeps its share at every window within
QUANTUM * (1 + log2(queues) / 2) tokens, or, where it has no queue of its own, within that and its own tokens: at most
1 / MAX_QUEUES of all.

One pass tokenises and stores ids with each document's place among its partition's tokens of the source; running sums
over (partition, source) give each partition's start in the queues; a second pass over the stored ids cuts the pieces.
Ids are shuffled only where there are more such starts than BROADCAST_ROWS. Only the last window can be short."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm.common import cut, running_sums, stash, table
from pollveil.llm.tokenize import default_path, tokenizer

WINDOW, END_ID = 2048, 1
#: Tokens of one turn; a divisor of the window.
QUANTUM = 512
#: Sources with less than this part of all tokens have no queue of their own, so that the driver holds a bounded table.
MAX_QUEUES = 1 << 16
#: Rows of (partition, source) starts that are broadcast at most (some 20 MB); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Documents whose pieces are made at once in a task.
STEP = 256


def muldiv(s: np.ndarray, m: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(s * m + c) // d, exact also where s * m has more than 64 bits (the remainder of the estimate wraps around)."""
    whole, m = m // d, m % d
    q = (s.astype(float) * m / d).astype(np.int64)
    return s * whole + q + (s * m + c - q * d) // d


@dataclass
class Tree:
    """Turns of queues that have `units` quanta each: node i has the sides 2 i and 2 i + 1, queue j is node leaves + j."""

    units: np.ndarray
    leaves: int = field(init=False)
    counts: np.ndarray = field(init=False)

    def __post_init__(self):
        self.leaves = 1 << max(0, len(self.units) - 1).bit_length()
        self.counts = np.zeros(2 * self.leaves, np.int64)
        self.counts[self.leaves : self.leaves + len(self.units)] = self.units
        for i in range(self.leaves - 1, 0, -1):
            self.counts[i] = self.counts[2 * i] + self.counts[2 * i + 1]

    def turn(self, queue: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Which turn of all (from 0) serves a queue's unit. With a and b quanta on the two sides of a node and n in all,
        the left side has had (k a + n // 2) // n of the first k turns."""
        node, at = queue + self.leaves, unit.copy()
        while len(node) and node[0] > 1:  # all leaves are equally deep
            left = node % 2 == 0
            own, other = self.counts[node], self.counts[node ^ 1]
            n = own + other
            # left: the least k with ((k + 1) a + n // 2) // n > at; right: the least k whose first k + 1 turns leave it at + 1
            at = muldiv(np.where(left, at + 1, at), n, np.where(left, own - 1 - n // 2, n // 2), own) - left
            node = node // 2
        return at


def phases(units: list[int], weights: list[float] | None) -> list[list[int]]:
    """Units of each queue in each phase. Within a phase the mixture is constant; a phase ends as a queue runs dry.
    Without weights each queue's share is that of its units, and all run dry together."""
    if weights is None:
        return [units] if sum(units) else []
    left, out = list(units), []
    while sum(left):
        w = [w if n else 0.0 for w, n in zip(weights, left, strict=True)]
        if not sum(w):
            w = [float(n) for n in left]
        ends = min((j for j, x in enumerate(w) if x), key=lambda j: left[j] / w[j])
        x = left[ends] / w[ends]
        quota = [left[j] if j == ends else min(left[j], round(w[j] * x)) for j in range(len(left))]
        left = [a - b for a, b in zip(left, quota, strict=True)]
        out.append(quota)
    return out


@dataclass
class Schedule:
    """Where each token goes. totals: tokens of sources with a queue of their own; small: tokens of all others."""

    totals: list[int]
    small: int
    weights: list[float] | None = None  # of the queues, and of the last one
    quantum: int = QUANTUM

    def __post_init__(self):
        whole = np.array(self.totals, np.int64) // self.quantum
        rest = np.array(self.totals, np.int64) - whole * self.quantum
        self.whole = whole * self.quantum  # a queue's tokens from here on are in the last queue
        self.ahead = np.concatenate([[0], np.cumsum(rest)]).astype(np.int64)  # their places there; small ones come last
        tail = int(self.ahead[-1]) + self.small
        self.units = np.append(whole, tail // self.quantum).astype(np.int64)
        found = phases(self.units.tolist(), self.weights)
        self.trees = [Tree(np.array(q, np.int64)) for q in found]
        self.starts = np.cumsum([np.zeros(len(self.units), np.int64), *(t.units for t in self.trees)], axis=0)  # units of each queue before each phase

    def place(self, queue: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The first token's place in the stream of all, for each queue's unit. The last queue's last unit comes last."""
        out = np.full(len(unit), int(self.units.sum()) * self.quantum, np.int64)
        for tree, start, end in zip(self.trees, self.starts, self.starts[1:], strict=False):
            own = np.nonzero((unit >= start[queue]) & (unit < end[queue]))[0]
            out[own] = (int(start.sum()) + tree.turn(queue[own], unit[own] - start[queue[own]])) * self.quantum
        return out

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """For documents that hold tokens first..first+n-1 of a source's queue, or of the small sources' tokens (queue =
        len(totals)): row, start in the document, length, window, offset in the window of each piece."""
        last = len(self.totals)
        row = np.arange(len(first))
        whole = np.append(self.whole, 0)[queue]
        inside = np.minimum(first + n, whole) - first  # tokens in the queue's whole quanta
        a, b = np.nonzero(inside > 0)[0], np.nonzero(inside < n)[0]
        skip = np.maximum(0, inside[b])
        own = np.concatenate([row[a], b])
        q = np.concatenate([queue[a], np.full(len(b), last)])
        begin = np.concatenate([first[a], self.ahead[queue[b]] + first[b] + skip - whole[b]])
        size = np.concatenate([inside[a], n[b] - skip])
        at = np.concatenate([np.zeros(len(a), np.int64), skip])
        u0, u1 = begin // self.quantum, (begin + size - 1) // self.quantum
        count = u1 - u0 + 1
        k = np.repeat(np.arange(len(own)), count)
        unit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + u0[k]
        low, high = np.maximum(begin[k], unit * self.quantum), np.minimum((begin + size)[k], (unit + 1) * self.quantum)
        pos = self.place(q[k], unit) + low - unit * self.quantum
        start, length, own = at[k] + low - begin[k], high - low, own[k]
        order = np.lexsort((start, own))
        own, start, length, pos = own[order], start[order], length[order], pos[order]
        # Stretches that follow each other in the document and in the window are one piece.
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (pos[1:] != pos[:-1] + length[:-1]) | (pos[1:] % window == 0)
        group = np.nonzero(new)[0]
        return own[group], start[group], np.add.reduceat(length, group) if len(group) else length, pos[group] // window, pos[group] % window


def _name(source: str | None) -> str:
    return "-" if source is None else f"={source}"


def tokenized(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """docs (doc_id, text, source) -> part, source, doc_id, before, n, ids: before counts the tokens of the same source
    ahead in the same partition; ids are little-endian unsigned 32-bit, with the end id. Stored once, as read again."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, so_far = tokenizer(path), TaskContext.get().partitionId(), Counter()
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                some = batch.slice(i, STEP)
                ids = [np.concatenate([tok.encode_document(t).astype("<u4"), tail]) for t in some.column("text").to_pylist()]
                sources = [_name(s) for s in some.column("source").to_pylist()]
                before = []
                for s, x in zip(sources, ids, strict=True):
                    before.append(so_far[s])
                    so_far[s] += len(x)
                columns = [pa.array([part] * len(ids), pa.int32()), pa.array(sources), some.column("doc_id"), pa.array(before, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "source", "doc_id", "before", "n", "ids"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.col("source").cast("string")).mapInArrow(encode, f"part int, source string, doc_id {kind}, before long, n long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None, window: int = WINDOW, targets: dict[str, float] | None = None, end_id: int | None = END_ID, quantum: int = QUANTUM) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, queue, ids (binary, little-endian unsigned 32-bit).

    targets: weight by source; all others share one queue of the smallest weight. None: each source's share of the
    corpus, the small ones together in the last queue. Null and empty texts are the end id alone; a text however long is
    packed whole; null sources form a queue of their own; repeated rows are packed each; ties in the order fall to the
    partitions' order; an empty table gives no pieces; other columns are not looked at. Documents with no ids give no
    piece."""
    if window % quantum:
        raise ValueError("the window must be a multiple of the quantum")
    stored = stash(tokenized(docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(source).alias("source")), path or default_path(), end_id))
    sums = cut(stored.groupBy("part", "source").agg(F.sum("n").alias("n")))
    by_source = cut(sums.groupBy("source").agg(F.sum("n").alias("n")))
    total = by_source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    least = max(quantum, -(-total // MAX_QUEUES))
    own = F.col("source").isin([_name(s) for s in targets]) if targets else F.col("n") >= least
    large = sorted((r.source, r.n) for r in by_source.where(own).collect())  # at most MAX_QUEUES rows, or the targets
    totals = [n for _, n in large]
    weights = [targets[s[1:]] for s, _ in large] + [min(targets.values())] if targets else None
    schedule = Schedule(totals, total - sum(totals), weights, quantum)
    queues = docs.sparkSession.createDataFrame([(s, j) for j, (s, _) in enumerate(large)], "source string, queue int")
    placed = sums.join(F.broadcast(queues), "source", "left").na.fill(len(large), ["queue"])
    starts = running_sums(placed, "n", "queue", "source", "part", to="ahead")
    before = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)  # of each queue in that order
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                some = batch.slice(i, STEP)
                q, first, n = (some.column(c).to_numpy().astype(np.int64) for c in ("queue", "first", "n"))
                at = np.nonzero(n > 0)[0]
                row, start, length, k, offset = schedule.pieces(q[at], first[at] - before[q[at]], n[at], window)
                row = at[row]
                ids = some.column("ids")
                views = {r: memoryview(ids[r].as_buffer()) for r in at.tolist()}
                data = [bytes(views[r][4 * a : 4 * (a + m)]) for r, a, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                columns = [some.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(n[row]), pa.array(k), pa.array(offset), pa.array(q[row].astype(np.int32)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "queue", "ids"])

    kind = dict(stored.dtypes)["doc_id"]
    rows = stored.join(starts.drop("n"), ["part", "source"]).select("doc_id", "queue", (F.col("ahead") + F.col("before")).alias("first"), "n", "ids")
    return rows.mapInArrow(cut_up, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, queue int, ids binary")


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
