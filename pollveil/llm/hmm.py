"""Hidden Markov language model over whole documents.

Tokens are words with A-Z in lower case, and one end. Counts of all training tokens give the base (a smoothed unigram
model) and the vocabulary's table, which stays in Spark. The HEAD most frequent words are symbols of the hidden Markov
model; other words share TAIL_CLASSES symbols by the hash of their last bytes, and a word's share of its class is its
smoothed share of the class's tokens: P(word | state) = P(class | state) (c + 0.5) / (class total).

Baum-Welch: each partition runs the scaled forward and backward recursions over its documents, many at a time, and
returns expected counts; Spark adds them up by blocks of the parameters, and the driver divides. The parameters start from
the neighbours of every symbol, counted over all training documents: the driver fits them to this table, whose size is fixed,
by START_ROUNDS rounds of EM. ROUNDS rounds then go over all training documents.
Scores are exact sequence likelihoods by the scaled forward recursion.

Counts of the KNOWN most frequent words go to every task; counts of rarer words reach documents by a join."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm.common import fold, stash, table

STATES, HEAD, TAIL_CLASSES, SUFFIX = 8, 16_384, 256, 3
#: Words whose counts each task has: at most so many, some 20 MB in a task.
KNOWN = 100_000
#: Rounds over all documents before gains are asked for.
WARM_ROUNDS = 0
#: Kinds of neighbours that the start goes by: so many commonest symbols one by one, the others dealt over the rest.
CONTEXTS, OWN_CONTEXTS, START_ROUNDS = 64, 48, 100
#: Rounds over all documents: another one as long as the last gained GAIN (natural logarithm) a token, ROUNDS at most.
ROUNDS, GAIN = 3, 0.01
#: Expected emission counts of a state get so many counts from the base.
PRIOR = 50.0
#: Words that a task counts before it hands them on; tokens that it holds to sort documents by length, and at once in
#: the recursions (a longer document is held whole).
FLUSH_WORDS, BUFFER_TOKENS, GROUP_TOKENS = 500_000, 2_000_000, 250_000
BLOCKS, PACK = 64, 256
END = b""


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, and white space is \x20 \x09-\x0D


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % TAIL_CLASSES


def vocabulary(train: DataFrame) -> DataFrame:
    """word (binary; the end is empty), class, n of all tokens of train's `text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            own = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(list(map(tail_class, own)), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "class", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py()))
            seen[END] += batch.num_rows
            if len(seen) > FLUSH_WORDS:
                yield hand_on()
        yield hand_on()

    counted = train.select("text").mapInArrow(count, "word binary, class int, n long").where("n > 0")
    return stash(counted.groupBy("word", "class").agg(F.sum("n").alias("n")))


@dataclass
class Lexicon:
    """What each task knows of the vocabulary: bounded by KNOWN and TAIL_CLASSES."""

    place: dict[bytes, int]
    log_count: np.ndarray
    symbol: np.ndarray
    log_class: np.ndarray
    symbol_mass: np.ndarray
    n_tokens: int
    n_words: int

    @property
    def log_total(self) -> float:
        return float(np.log10(self.n_tokens + 0.5 * (self.n_words + 1)))


def lexicon(vocab: DataFrame, head: int = HEAD, known: int = KNOWN) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and the part of the vocabulary that it leaves out.

    The `known` commonest words are taken, of equals the first. A histogram of the counts on a logarithmic scale tells
    which of its grades fit as a whole; the next one is taken in part, so that no more words than those reach the driver."""
    grade = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(((r["grade"], r.words, r.n) for r in vocab.groupBy(grade.alias("grade")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()), reverse=True)
    n_words, n_tokens, taken, lowest, partial = sum(w for _, w, _ in steps), sum(n for _, _, n in steps), 0, None, None
    for step, w, _ in steps:  # about 16 rows for each doubling of the largest count
        if taken + w > known:
            partial = step
            break
        taken, lowest = taken + w, step
    frequent = (grade >= lowest) if lowest is not None else F.lit(False)
    if partial is not None and taken < known:
        last = vocab.where(grade == partial).orderBy(F.desc("n"), "word").limit(known - taken).orderBy("n", F.desc("word")).first()
        frequent |= (grade == partial) & ((F.col("n") > last.n) | (F.col("n") == last.n) & (F.col("word") <= F.lit(bytes(last.word))))
    found = vocab.where(frequent).toArrow()
    rest = vocab.where(~frequent)
    own, n, cls = found.column("word").to_pylist(), found.column("n").to_numpy(), found.column("class").to_numpy()
    order = sorted(range(len(own)), key=lambda i: (-n[i], own[i]))
    own, n, cls = [own[i] for i in order], n[order].astype(float), cls[order].astype(int)
    totals = np.bincount(cls[head:], n[head:] + 0.5, minlength=TAIL_CLASSES).astype(float)  # of no words it is whole numbers
    for r in rest.groupBy("class").agg(F.sum(F.col("n") + 0.5).alias("n")).collect():  # a row for each class
        totals[r["class"]] += float(r.n)
    symbol = np.where(np.arange(len(own)) < head, np.arange(len(own)), min(head, len(own)) + cls).astype(np.uint16)
    mass = np.concatenate([n[:head], totals + 0.5])
    return Lexicon({w: i for i, w in enumerate(own)}, np.log10(n + 0.5), symbol, np.log10(totals + 0.5), mass, n_tokens, n_words), rest


def encoded(docs: DataFrame, shared) -> DataFrame:
    """docs (doc_id, text, held_out) -> key, doc_id, held_out, n_tokens, n_here, counts_here (sum of log10(c + 0.5) of
    words in the lexicon), in_class (the logarithms that the model adds for words that are no symbols, without their
    counts where the lexicon lacks them), symbols (unsigned 16-bit), others (words that the lexicon lacks). Stored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        n_head = len(lex.symbol_mass) - TAIL_CLASSES
        key = TaskContext.get().partitionId() << 33
        others = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text"):
                own = words(text.as_py())
                own.append(END)
                at = np.fromiter(map(lex.place.get, own, repeat(-1)), np.int32, len(own))
                here = at >= 0
                symbols = np.zeros(len(own), np.uint16)
                symbols[here] = lex.symbol[at[here]]
                counts = lex.log_count[at[here]]
                missing = Counter(own[i] for i in np.nonzero(~here)[0].tolist())
                if missing:
                    symbols[~here] = [n_head + tail_class(own[i]) for i in np.nonzero(~here)[0].tolist()]
                tail = symbols >= n_head
                in_class = counts[tail[here]].sum() - lex.log_class[symbols[tail].astype(int) - n_head].sum()
                rows.append((key, len(own), int(here.sum()), float(counts.sum()), float(in_class), symbols.tobytes(), [{"word": w, "n": n} for w, n in missing.items()]))
                key += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), others)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([columns[0], batch.column("doc_id"), batch.column("held_out"), *columns[1:]], ["key", "doc_id", "held_out", "n_tokens", "n_here", "counts_here", "in_class", "symbols", "others"])

    kind = dict(docs.dtypes)["doc_id"]
    return stash(docs.select("doc_id", "text", "held_out").mapInArrow(encode, f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_here long, counts_here double, in_class double, symbols binary, others array<struct<word:binary,n:int>>"))


@dataclass
class Parameters:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    def pack(self) -> np.ndarray:
        return np.concatenate([self.start, self.move.ravel(), self.emit.ravel()])


def first_parameters(mass: np.ndarray, states: int = STATES, seed: int = 11) -> Parameters:
    rng = np.random.default_rng(seed)
    emit = mass[:, None] * rng.gamma(2.0, 0.5, (len(mass), states)) + 1e-12
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Parameters(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def groups(buffer: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Documents of like length together, the longest first."""
    buffer.sort(key=lambda x: -len(x[1]))
    i = 0
    while i < len(buffer):
        n, j = 0, i
        while j < len(buffer) and (j == i or n + len(buffer[j][1]) <= GROUP_TOKENS):
            n += len(buffer[j][1])
            j += 1
        yield np.array([k for k, _ in buffer[i:j]]), [s for _, s in buffer[i:j]]
        i = j


def by_time(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all documents (longest first) step by step, each step's first place and its number of documents."""
    lengths = np.array([len(d) for d in docs])
    active = len(docs) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
    begin = np.concatenate([[0], np.cumsum(active)[:-1]])
    flat = np.empty(lengths.sum(), np.int64)
    for i, d in enumerate(docs):
        flat[begin[: len(d)] + i] = d
    return flat, begin, active


def forward(p: Parameters, flat: np.ndarray, begin: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward probabilities, scales and emission probabilities by place."""
    emit = p.emit[flat]
    alpha, scale = np.empty_like(emit), np.empty(len(flat))
    for t, (b, n) in enumerate(zip(begin.tolist(), active.tolist(), strict=True)):
        a = alpha[b : b + n]
        if t:
            np.matmul(alpha[last : last + n], p.move, out=a)
            a *= emit[b : b + n]
        else:
            np.multiply(p.start, emit[:n], out=a)
        s = a.sum(axis=1)
        scale[b : b + n] = s
        a /= s[:, None]
        last = b
    return alpha, scale, emit


def log_likelihoods(p: Parameters, docs: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of each document, the longest first."""
    flat, begin, active = by_time(docs)
    _, scale, _ = forward(p, flat, begin, active)
    logs, out = np.log(scale), np.zeros(len(docs))
    for b, n in zip(begin.tolist(), active.tolist(), strict=True):
        out[:n] += logs[b : b + n]
    return out


def expect(p: Parameters, docs: list[np.ndarray], total: Parameters) -> float:
    """Adds the documents' expected counts to total; their log likelihood."""
    flat, begin, active = by_time(docs)
    alpha, scale, emit = forward(p, flat, begin, active)
    emit /= scale[:, None]
    beta = np.ones((active[0], p.move.shape[0]))
    gamma = alpha  # becomes the states' posteriors, from the last step on
    moves = np.zeros_like(p.move)
    for t in range(len(begin) - 2, -1, -1):
        b, nxt, n = begin[t], begin[t + 1], active[t + 1]
        ahead = emit[nxt : nxt + n] * beta[:n]
        a = alpha[b : b + n]
        moves += a.T @ ahead
        beta[:n] = ahead @ p.move.T
        gamma[b : b + n] = a * beta[:n]
    total.start += gamma[: active[0]].sum(axis=0)
    total.move += moves * p.move
    for s in range(p.move.shape[0]):
        total.emit[:, s] += np.bincount(flat, gamma[:, s], minlength=len(p.emit))
    return float(np.log(scale).sum())


def buffered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Pairs of key and symbols, about BUFFER_TOKENS at once."""
    held: list[tuple[int, np.ndarray]] = []
    n = 0
    for batch in batches:
        for key, data in zip(batch.column("key").to_pylist(), batch.column("symbols"), strict=True):
            held.append((key, np.frombuffer(data.as_py(), np.uint16)))
            n += len(held[-1][1])
            if n >= BUFFER_TOKENS:
                yield held
                held, n = [], 0
    yield held


def summed(docs: DataFrame, work) -> np.ndarray | None:
    """The arrays that work makes of each partition of docs (key, symbols), added up; null of no partitions."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.array_split(work(batches), BLOCKS)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "block", "sums"])

    def add(one: pa.Table) -> pa.Table:
        own = one.sort_by("part")
        sums = sum(np.frombuffer(x.as_py(), float) for x in own.column("sums"))
        return pa.table({"block": own.column("block").slice(0, 1), "part": own.column("part").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    # Merged in two steps, so that no group grows with the tasks: PACK rows of one block, then one row for PACK tasks.
    each = docs.select("key", "symbols").mapInArrow(arrays, "part int, block int, sums binary")
    packs = each.groupBy("block", F.floor(F.col("part") / PACK).cast("int").alias("pack")).applyInArrow(add, "block int, part int, sums binary")
    found = packs.groupBy("block").applyInArrow(add, "block int, part int, sums binary").collect()  # BLOCKS rows, as long as the array
    return np.concatenate([np.frombuffer(r.sums, float) for r in sorted(found, key=lambda r: r.block)]) if found else None


def contexts(symbols: int) -> np.ndarray:
    """The kind of each symbol as a neighbour. Symbols are in the order of their frequency."""
    at = np.arange(symbols)
    return np.where(at < OWN_CONTEXTS, at, OWN_CONTEXTS + at % (CONTEXTS - OWN_CONTEXTS))


def neighbours(docs: DataFrame, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """symbols x CONTEXTS: how often each symbol stands before, and behind, a neighbour of each kind, in all docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        kind, size = contexts(symbols), symbols * CONTEXTS
        total = np.zeros(2 * size)
        for held in buffered(batches):
            if held:
                flat = np.concatenate([s for _, s in held]).astype(np.int64)
                inside = np.ones(len(flat), bool)
                inside[np.cumsum([len(s) for _, s in held]) - 1] = False  # a document's last symbol is before none
                one, two = flat[:-1][inside[:-1]], flat[1:][inside[:-1]]
                total[:size] += np.bincount(one * CONTEXTS + kind[two], minlength=size)
                total[size:] += np.bincount(two * CONTEXTS + kind[one], minlength=size)
        return total

    found = summed(docs, work)
    both = np.zeros((2, symbols, CONTEXTS)) if found is None else found.reshape(2, symbols, CONTEXTS)
    return both[0], both[1]


def fitted(p: Parameters, ahead: np.ndarray, behind: np.ndarray, mass: np.ndarray, rounds: int = START_ROUNDS) -> Parameters:
    """p after rounds of EM on pairs of neighbours, of which one is known by its kind alone. Emissions are counted for the
    known one only, so that the likelihood need not rise in every round: a start, which Baum-Welch goes on from."""
    kind, base = contexts(len(mass)), PRIOR * (mass / mass.sum())[:, None]
    member = np.zeros((CONTEXTS, len(mass)))
    member[kind, np.arange(len(mass))] = 1
    share, move, emit = p.start, p.move, p.emit
    if not ahead.any():
        return p
    for _ in range(rounds):
        known, joint = member @ emit, share[:, None] * move
        own, right, left = emit * share, move @ known.T, joint.T @ known.T
        one, two = (np.divide(n, z, out=np.zeros_like(n), where=n > 0) for n, z in ((ahead, own @ right), (behind, emit @ left)))
        moves = joint * (emit.T @ one @ known + known.T @ two.T @ emit)
        emit = own * (one @ right.T) + emit * (two @ left.T) + base
        emit, moves = emit / emit.sum(axis=0), moves + 0.1
        share, move = moves.sum(axis=1) / moves.sum(), moves / moves.sum(axis=1, keepdims=True)
    return Parameters(p.start, move, emit)


def one_round(docs: DataFrame, p: Parameters, mass: np.ndarray) -> tuple[Parameters, float]:
    """Baum-Welch over docs (key, symbols): new parameters, and the log likelihood under the old ones."""
    shared = docs.sparkSession.sparkContext.broadcast(p)  # (HEAD + TAIL_CLASSES) x STATES numbers
    states, symbols = len(p.start), len(p.emit)

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        now = shared.value
        total, likelihood = Parameters(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))), 0.0
        for held in buffered(batches):
            for _, own in groups(held):
                likelihood += expect(now, own, total)
        return np.concatenate([[likelihood], total.pack()])

    flat = summed(docs, work)
    shared.unpersist()
    if flat is None:
        return p, 0.0
    start, move, emit = flat[1 : 1 + states], flat[1 + states : 1 + states + states**2].reshape(states, states), flat[1 + states + states**2 :].reshape(symbols, states)
    emit = emit + PRIOR * (mass / mass.sum())[:, None]
    move, start = move + 0.1, start + 0.1
    return Parameters(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)), float(flat[0])


def train(coded: DataFrame, mass: np.ndarray) -> Parameters:
    own = coded.where("not held_out")
    p = fitted(first_parameters(mass), *neighbours(own, len(mass)), mass)
    for _ in range(WARM_ROUNDS):
        p, _ = one_round(own, p, mass)
    tokens, before = own.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n, None
    for _ in range(ROUNDS):
        new, likelihood = one_round(own, p, mass)
        if before is not None and likelihood - before < GAIN * tokens:
            break  # what this round would add is less than the last one's
        p, before = new, likelihood
    return p


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text,
    held_out). Null texts count as empty: their only token is the end. With no training rows every word is unknown. Texts
    are scored whole, however long; repeated rows get equal rows. An empty table gives no rows; other columns are not
    looked at."""
    vocab = vocabulary(docs.where("not held_out"))
    lex, rest = lexicon(vocab)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(lex)  # KNOWN words at most
    coded = encoded(docs, shared)
    p = sc.broadcast(train(coded, lex.symbol_mass))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in buffered(batches):
            for keys, own in groups(held):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(log_likelihoods(p.value, own) / np.log(10))], ["key", "hidden"])

    hidden = coded.select("key", "symbols").mapInArrow(likelihood, "key long, hidden double")
    rare = coded.select("key", F.inline("others")).join(rest.select("word", F.col("n").alias("c")), "word", "left")
    rare = rare.groupBy("key").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("counts_there"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_there"))
    rows = coded.drop("symbols", "others").join(hidden, "key").join(rare, "key", "left").na.fill(0, ["counts_there", "n_there"])
    base = F.col("counts_here") + F.col("counts_there") - F.col("n_tokens") * F.lit(lex.log_total)
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_here") + F.col("n_there")).alias("n_known"), F.lit(lex.n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("hidden") + F.col("in_class") + F.col("counts_there")).alias("score"))


def op6_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"))
    return score(docs)
