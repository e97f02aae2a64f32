"""Runs of periodic words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q that no neighbouring word extends. Its squares (q words, twice) are
found in three steps on the suffix tree of a stretch of text. (1) The stretch is cut into Lempel-Ziv blocks, each the
longest word sequence that begins earlier as well; common extensions around each block's begin give pairs (start, length)
that cover the leftmost occurrence of every square. (2) From the leaves up, each pair is marked on the tree edge where its
square ends; of the lists of a node's children that of the leftmost leaf goes up. (3) From each mark suffix links lead to
the square's rotations, until one is not in the text or marked already: the marks are now the whole vocabulary of squares.
Leaves below the marks of primitive squares are their places, and places that follow each other merge into runs.

Few words of a corpus lie in runs. A run of period q repeats each of its k-grams after q words. So a first pass over whole
batches of documents looks for stretches whose every k-gram stood at most D words earlier, for D a power of two and q
above D / 2, long enough for a run of such a period; the method runs on these stretches, with the D words before them.
k-grams are compared by hash, which may only add stretches: no run is lost, and a run lies in one stretch as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm.common import table

# Fixed values of the contract: a run's least number of words, and of periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Text of the documents that the first pass takes at once (at least one document).
STEP_BYTES = 2 << 20
GRAMS = (8, 4, 2, 1)
FAR = np.int64(1) << 40


class Extensions:
    """Suffix array and common extensions of a sequence of numbers, by ranks of its windows of 1, 2, 4.. numbers."""

    def __init__(self, c: np.ndarray):
        n = self.n = len(c)
        rank = np.unique(c, return_inverse=True)[1].astype(np.int64)
        self.ranks, width = [rank.astype(np.int32)], 1
        while True:
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1  # windows past the end come first
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
            self.ranks.append(rank.astype(np.int32))
            width *= 2
            if width >= n or rank[order[-1]] == n - 1:
                break
        self.sa, self.rank = order, rank

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers that the sequences from i and from j (another place) share at their begins."""
        length = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            r, a, b = self.ranks[level], i + length, j + length
            inside = (a < self.n) & (b < self.n)
            same = inside & (r[np.where(inside, a, 0)] == r[np.where(inside, b, 0)])
            length += same.astype(np.int64) << level
        return length

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers that the sequences up to i and up to j share at their ends; both places count, and -1 is before all."""
        length = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            r, a, b = self.ranks[level], i - length - (1 << level) + 1, j - length - (1 << level) + 1
            inside = (a >= 0) & (b >= 0)
            same = inside & (r[np.where(inside, a, 0)] == r[np.where(inside, b, 0)])
            length += same.astype(np.int64) << level
        return length


def block_starts(x: Extensions, lcp: np.ndarray) -> list[int]:
    """Where the Lempel-Ziv blocks begin. Suffixes leave a list in suffix order from the last to the first; the neighbours
    that one still has begin earlier, and the longer match of the two is its block's length."""
    n, rank = x.n, x.rank.tolist()
    shared = lcp.tolist() + [0]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    longest = [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        a, b = before[r], after[r]
        own, other = shared[r], shared[b]
        longest[i] = own if own > other else other
        if other > own:
            shared[b] = own
        if a >= 0:
            after[a] = b
        if b < n:
            before[b] = a
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += longest[i] or 1
    return starts


def covering_squares(x: Extensions, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of squares that cover the leftmost occurrence of each kind: with the centre in a block, they begin in
    it and reach the next, or begin before it."""
    begin = np.array(starts, np.int64)
    end = np.append(begin[1:], x.n)
    size, after = end - begin, np.append(np.diff(np.append(begin[1:], x.n)), 0)[: len(begin)]

    def steps(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and k, from 1 to n of the block."""
        block = np.repeat(np.arange(len(n)), n)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n) + 1

    block, k = steps(np.where(end < x.n, size, 0))
    at, q = end[block], end[block] - k
    right, left = x.forward(at, q), x.backward(at - 1, q - 1)
    ok = (right + left >= k) & (right > 0)
    one = np.maximum(q - left, q - k + 1)[ok], 2 * k[ok]

    block, k = steps(size + after)
    at, inside = begin[block], begin[block] + k < x.n
    block, k, at = block[inside], k[inside], at[inside]
    right, left = x.forward(at, at + k), x.backward(at - 1, at + k - 1)
    start = np.maximum(at - left, at - k + 1)
    ok = (right + left >= k) & (right > 0) & (left > 0) & (start + k <= end[block])
    return np.concatenate([one[0], start[ok]]), np.concatenate([one[1], 2 * k[ok]])


class SuffixTree:
    """Leaves 0.. in suffix order, then inner nodes; the root is node n. low and high: a node's leaves."""

    def __init__(self, x: Extensions, lcp: np.ndarray):
        n, self.x = x.n, x
        self.sa, self.place = x.sa.tolist(), x.rank.tolist()
        self.root, shared = n, lcp.tolist()
        self.depth = [n - i for i in self.sa] + [0]
        self.parent, self.low, self.high = [-1] * (n + 1), list(range(n)) + [0], list(range(n)) + [n - 1]
        depth, parent, low, high = self.depth, self.parent, self.low, self.high
        self.first = self.sa + [0]  # the leftmost leaf's place
        first, stack, self.order = self.first, [n], []  # inner nodes, children before parents
        for r in range(1, n + 1):
            length, child = shared[r] if r < n else -1, r - 1
            while depth[stack[-1]] > length and stack[-1] != n:
                v = stack.pop()
                parent[child], high[v] = v, r - 1
                first[v] = min(first[v], first[child])
                self.order.append(v)
                child = v
            top = stack[-1]
            if depth[top] < length:
                top = len(depth)
                depth.append(length)
                parent.append(-1)
                low.append(low[child])
                high.append(-1)
                first.append(first[child])
                stack.append(top)
            parent[child] = top
            first[top] = min(first[top], first[child])

    def link(self, c: list[int]) -> None:
        """Suffix links of inner nodes, and children by their edge's first number (c: the sequence)."""
        n, sa, depth, parent, low = self.x.n, self.sa, self.depth, self.parent, self.low
        self.down: dict[tuple[int, int], int] = {}
        below = [-1] * len(depth)  # a child, a leaf if there is one
        for y in range(len(depth) - 1, -1, -1):
            p = parent[y]
            if p < 0:
                continue
            at = sa[low[y]] + depth[p]
            if at < n:
                self.down[p, c[at]] = y
            below[p] = y
        self.links = [-1] * len(depth)
        for v in self.order:
            self.links[v] = self.above(self.suffix(below[v]), depth[v] - 1)

    def suffix(self, v: int) -> int:
        """A node at or below the place of v's sequence without its first number."""
        if v >= self.x.n:
            return self.links[v]
        i = self.sa[v] + 1
        return self.place[i] if i < self.x.n else self.root

    def above(self, v: int, length: int) -> int:
        """The highest ancestor of v, or v, that is as deep as length."""
        parent, depth = self.parent, self.depth
        while parent[v] >= 0 and depth[parent[v]] >= length:
            v = parent[v]
        return v


def vocabulary(c: np.ndarray) -> tuple[SuffixTree | None, set[tuple[int, int]]]:
    """The tree, and (node, length) of every kind of square that the sequence holds: it ends on the edge to the node."""
    if len(c) < 2:
        return None, set()
    x = Extensions(c)
    lcp = np.zeros(x.n, np.int64)
    lcp[1:] = x.forward(x.sa[:-1], x.sa[1:])
    start, length = covering_squares(x, block_starts(x, lcp))
    tree, own = SuffixTree(x, lcp), c.tolist()
    tree.link(own)
    lists: dict[int, list[int]] = {}  # of each leaf's place: lengths, the shortest first
    for i, n in sorted(set(zip(start.tolist(), (-length).tolist(), strict=True))):
        lists.setdefault(i, []).append(-n)
    for of in lists.values():
        of.reverse()
    depth, parent, first = tree.depth, tree.parent, tree.first
    marks: set[tuple[int, int]] = set()
    for v in [*range(x.n), *tree.order]:
        # A list belongs to the leftmost leaf and is used up from its long end; at a node whose leftmost leaf is another
        # one, it has stayed behind.
        of = lists.get(first[v])
        while of and of[-1] > depth[parent[v]]:
            marks.add((v, of.pop()))
    walk = list(marks)
    for v, n in walk:
        while True:
            number = own[tree.sa[tree.low[v]]]
            v = tree.above(tree.suffix(v), n - 1)
            if depth[v] == n - 1:
                v = tree.down.get((v, number), -1)
                if v < 0:
                    break
            elif own[tree.sa[tree.low[v]] + n - 1] != number:
                break
            if (v, n) in marks:
                break
            marks.add((v, n))
    return tree, marks


def runs(c: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """(start, length, period) of the runs of a sequence, rows sorted by start and period."""
    tree, marks = vocabulary(c)
    if not marks:
        return np.zeros((0, 3), np.int64)
    node, length = np.array(sorted(marks), np.int64).T
    low, high = np.array(tree.low, np.int64)[node], np.array(tree.high, np.int64)[node]
    q, x = length // 2, tree.x
    at = x.sa[low]
    primitive, rest, p = np.ones(len(q), bool), q.copy(), 2
    while (rest > 1).any():  # a root is a power if it has a period that is a prime's part of it
        if p * p > rest.max():
            of = np.nonzero(rest > 1)[0]
            primes = rest[of]
        else:
            of = np.nonzero(rest % p == 0)[0]
            primes = np.full(len(of), p)
        part = q[of] // primes
        primitive[of] &= x.forward(at[of], at[of] + part) < q[of] - part
        if p * p > rest.max():
            break
        while (more := rest % p == 0).any():
            rest[more] //= p
        p += 1
    low, high, q = low[primitive], high[primitive], q[primitive]
    n = high - low + 1
    place = x.sa[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    period = np.repeat(q, n)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.concatenate([[True], (np.diff(period) != 0) | (np.diff(place) != 1)])
    begin = np.nonzero(new)[0]
    end = np.append(begin[1:], len(place)) - 1
    out = np.stack([place[begin], place[end] - place[begin] + 2 * period[begin], period[begin]], axis=1)
    out = out[out[:, 1] >= np.maximum(min_words, min_periods * out[:, 2])]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def last_seen(gram: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How far back each gram stood last; FAR if it did not, and where a document begins."""
    order = np.argsort(gram, kind="stable")
    out = np.full(len(gram), FAR)
    same = gram[order[1:]] == gram[order[:-1]]
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    out[begins[begins < len(out)]] = FAR
    return out


def stretches(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, min_words: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(document, begin, end): disjoint stretches of a batch that hold every run. codes: the documents' words one after
    another, no number in two documents."""
    found: list[tuple[int, int, int]] = []
    if not len(codes):
        return found
    seen: dict[int, np.ndarray] = {}
    longest, far = int((ends - begins).max()), 1
    while min_periods * (far // 2 + 1) <= longest:
        least = max((min_periods - 1) * (far // 2 + 1), min_words - far)  # words of a run behind its first period
        k = next((k for k in GRAMS if least - k + 1 >= k), 1)
        if k not in seen:
            gram = codes.astype(np.uint64)
            for _ in range(k.bit_length() - 1):
                width = 1 << _
                gram = gram[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * _) + gram[width:] if len(gram) > width else gram[:0]
                gram ^= gram >> np.uint64(29)
            seen[k] = last_seen(gram, begins)
        near = np.concatenate([[0], (seen[k] <= far).view(np.int8), [0]])
        edges = np.diff(near)
        a, b = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        long = b - a >= max(1, least - k + 1)
        for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True):
            doc = int(np.searchsorted(begins, x, "right")) - 1
            found.append((doc, max(int(begins[doc]), x - far), min(int(ends[doc]), y + k - 1)))
        far *= 2
    found.sort()
    out: list[tuple[int, int, int]] = []
    for doc, a, b in found:
        if out and out[-1][0] == doc and a <= out[-1][2]:
            out[-1] = doc, out[-1][1], max(b, out[-1][2])
        else:
            out.append((doc, a, b))
    return out


def _batch(texts: list[str | None], min_words: int, min_periods: int) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Words and runs of each text."""
    words, codes, base = [(t or "").encode().split() for t in texts], [], 0
    for own in words:
        known: dict[bytes, int] = {}
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)) + base)
        base += len(known)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    some = sizes > 0
    every = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    place = np.nonzero(some)[0]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for doc, a, b in stretches(every, begins[some], ends[some], min_words, min_periods):
        own = runs(every[a:b], min_words, min_periods)
        own[:, 0] += a - begins[place[doc]]
        found[place[doc]].append(own)
    return words, [np.concatenate(f) if f else np.zeros((0, 3), np.int64) for f in found]


def collapse(words: list[bytes], own: np.ndarray) -> str:
    """The words without those that a run contains behind its first period."""
    if len(own):
        keep = np.ones(len(words), bool)
        for start, length, period in own.tolist():
            keep[start + period : start + length] = False
        words = [words[i] for i in np.nonzero(keep)[0].tolist()]
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words; by start and period), collapsed (the text's words, joined by
    one blank, each run reduced to its first period): a row for each row of docs.

    Words are parted by ASCII white space and compared as they are. Null, empty and blank texts have no words; texts are
    taken whole, however long. Runs may overlap, each counts. Repeated rows give equal rows. An empty table gives no rows;
    other columns are not looked at. min_periods is 2 at least."""
    if min_periods < 2:
        raise ValueError("a run holds its period twice at least")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (int(size[at - 1]) if at else 0) + STEP_BYTES, "right")))
                some = batch.slice(at, to - at)
                at = to
                words, own = _batch(some.column("text").to_pylist(), min_words, min_periods)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in own])]).astype(np.int32)
                rows = np.concatenate(own)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"]))
                texts = [collapse(w, r) for w, r in zip(words, own, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), listed, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(find, f"doc_id {dict(own.dtypes)['doc_id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: documents whose id's crc32 is divisible by ten get a periodic tail, as the contract has it. A null id
    plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n").cast("int")))
    own = own.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    turned = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return own.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), "best.length", (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
