"""Language identification with error-correcting output codes.

Each language has a codeword. For each bit a binary n-gram classifier (a naive Bayes log-odds of hashed byte 2- and
3-grams, languages weighted alike) tells the languages with 1 from those with 0. A text is decoded by loss: the
codeword whose bits have the smallest sum of logistic losses of the classifiers' margins wins; a document whose two
best codewords lie close together is flagged as ambiguous.

The classifiers are fitted on about TRAIN_ROWS labelled documents of each language (all of a rarer one), drawn by a
hash; every label that occurs is learned. Every document is then scored on its whole text. Counts by language stay in
Spark: the driver gets N_FEATURES weights for each bit, and the number of bits grows with the logarithm of the languages'."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm.common import cut, fold, table

#: Labelled documents a language for fitting, about.
TRAIN_ROWS = 2000
#: Languages whose shares are broadcast at most (10 MB); with more, the texts are dealt by language.
BROADCAST_LANGUAGES = 100_000
#: Languages of whose codewords all pairs are compared.
COMPARED = 256
GRAM_BITS = 16
N_FEATURES = 2 << GRAM_BITS
SMOOTHING = 0.5
#: Scale of a mean log-odds in the logistic loss; two codewords are close where the losses differ by less a bit.
SCALE, AMBIGUOUS = 8.0, 0.05
#: Bytes of text whose grams are held at once, and rows of a batch that are.
CHUNK, STEP = 1 << 20, 512
_LETTER = regex.compile(r"\p{L}")
#: Languages whose counts a task holds before it hands them on (1 MB each).
HELD = 64
#: Features whose weights are made at once in a task: so many numbers for each language.
BLOCK = 256
#: ASCII: letters in lower case, all else a blank; other bytes stay.
_PLAIN = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: all ways to part up to five languages in two; beyond that 15 log2(n) random columns. Up to
    COMPARED languages the draw of several counts whose closest rows are farthest apart; beyond, where all pairs are too
    many, the first draw without equal rows: two rows of so many bits differ in about half of them."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        words = np.arange(1, 1 << (n - 1))
        return np.where(np.concatenate([np.zeros((1, len(words)), int), (words >> np.arange(n - 1)[:, None]) & 1]), -1, 1).astype(np.int8)
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(15 * np.log2(n)))
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.int8), (n, width))
        m = m[:, abs(m.sum(axis=0)) < n]
        if n > COMPARED:
            if len(np.unique(np.packbits(m > 0, axis=1), axis=0)) == n:
                return m
            continue
        d = (m.shape[1] - m.astype(int) @ m.T.astype(int)) // 2 + np.eye(n, dtype=int) * width
        if best is None or d.min() > best[0]:
            best = d.min(), m
    return best[1]


def plain(text: str | None) -> bytes:
    """The bytes of whose grams a text consists: lower case, runs of what is no letter as one blank, blanks around."""
    return b" " + b" ".join((text or "").lower().encode().translate(_PLAIN).split()) + b" "


def grams(data: np.ndarray) -> np.ndarray:
    """The features at each byte of data but the last two: its 2-gram, and its 3-gram hashed."""
    a = data.astype(np.uint32)
    two = (a[:-2] << 8) | a[1:-1]
    three = (((two << 8) | a[2:]) * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
    return np.stack([two, three + np.uint32(1 << GRAM_BITS)])


def gram_counts(texts: list[str | None]) -> np.ndarray:
    out = np.zeros(N_FEATURES, np.int64)
    for text in texts:
        data = np.frombuffer(plain(text), np.uint8)
        for i in range(0, max(0, len(data) - 2), CHUNK):
            out += np.bincount(grams(data[i : i + CHUNK + 2]).ravel(), minlength=N_FEATURES)
    return out


def margins(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """For each text and bit the mean log-odds of its grams; 0 for a text without any."""
    out = np.zeros((len(texts), weights.shape[1]))
    for r, text in enumerate(texts):
        data = np.frombuffer(plain(text), np.uint8)
        if len(data) < 3:
            continue
        for i in range(0, len(data) - 2, CHUNK):
            out[r] += weights[grams(data[i : i + CHUNK + 2])].sum(axis=(0, 1), dtype=np.float64)
        out[r] /= len(data) - 2
    return out


def decode(m: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the nearest codeword, a score from 0 to 1, and whether another is close."""
    one, zero = np.logaddexp(0, -SCALE * m), np.logaddexp(0, SCALE * m)
    # A bit adds `one` or `zero` as its code says: half their sum, and half their difference with the code's sign.
    loss = ((one + zero) / 2).sum(axis=1, keepdims=True) + ((one - zero) / 2) @ code.T.astype(float)
    best, row = loss.argmin(axis=1), np.arange(len(m))
    least = loss[row, best]
    score = 1 / np.exp(least[:, None] - loss).sum(axis=1)
    if len(code) == 1:
        return best, score, np.zeros(len(m), bool)
    loss[row, best] = np.inf
    return best, score, (loss.min(axis=1) - least) / code.shape[1] < AMBIGUOUS


def log_odds(counts: np.ndarray, totals: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Weights (features x bits) from the features' counts in each language (rows) and the languages' totals."""
    p = (counts + SMOOTHING) / (totals[:, None] + SMOOTHING * N_FEATURES)
    one, zero = code > 0, code < 0
    mean = lambda side: (side.T.astype(float) @ p) / np.maximum(1, side.sum(axis=0))[:, None]
    both = (one.any(axis=0) & zero.any(axis=0))[:, None]
    return np.where(both, np.log(np.where(both, mean(one), 1.0)) - np.log(np.where(both, mean(zero), 1.0)), 0.0).T.astype(np.float32)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, code: np.ndarray | None = None):
        self.languages, self.code, self.weights = languages, code_matrix(len(languages)) if code is None else code, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (und: no letter, or nothing was learned), score and whether it is ambiguous."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best, score, close = decode(margins(texts, self.weights), self.code)
        blank = np.array([not _LETTER.search(t or "") for t in texts], bool)
        names = ["und" if b else self.languages[k] for b, k in zip(blank.tolist(), best.tolist(), strict=True)]
        return names, np.where(blank, 0.0, score), close | blank


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model of the labelled documents given. Rows with a null text or lang teach nothing."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = cut(known.groupBy("lang").count())
    share = sizes.select("lang", F.least(F.lit(1.0), rows / F.col("count")).alias("share"))
    few = sizes.count() <= BROADCAST_LANGUAGES
    sample = known.join(F.broadcast(share) if few else share, "lang").where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for name, c in total.items():
                at = np.nonzero(c)[0]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "feature", "n"])
            total.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                some = batch.slice(i, STEP)
                by: dict[str, list[str]] = {}
                for t, name in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    by.setdefault(name, []).append(t)
                for name, texts in by.items():
                    total[name] = total.get(name, 0) + gram_counts(texts)
                    if len(total) > HELD:
                        yield from hand_on()
        yield from hand_on()

    summed = cut(sample.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    heard = sorted((r.lang, r.n) for r in summed.groupBy("lang").agg(F.sum("n").alias("n")).collect())  # a row for each language
    names, totals = [n for n, _ in heard], np.array([t for _, t in heard], float)
    code = code_matrix(len(names))
    place = docs.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "lang string, at int")

    def weigh(block: pa.Table) -> pa.Table:
        first = int(block.column("block")[0].as_py()) * BLOCK
        counts = np.zeros((len(totals), BLOCK))
        counts[block.column("at").to_numpy(), block.column("feature").to_numpy() - first] = block.column("n").to_numpy()
        return pa.table({"block": block.column("block").slice(0, 1), "weights": pa.array([log_odds(counts, totals, code).tobytes()], pa.binary())})

    weights = np.tile(log_odds(np.zeros((len(totals), 1)), totals, code), (N_FEATURES, 1)) if names else np.zeros((N_FEATURES, 1), np.float32)
    blocks = summed.join(F.broadcast(place), "lang").withColumn("block", F.floor(F.col("feature") / BLOCK).cast("int")).select("block", "at", "feature", "n")
    for r in blocks.groupBy("block").applyInArrow(weigh, "block int, weights binary").toLocalIterator():  # N_FEATURES / BLOCK rows
        weights[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.weights, np.float32).reshape(BLOCK, -1)
    return Model(names, weights, code)


def identify(docs: DataFrame, model: Model, text: str = "text", to: str = "language") -> DataFrame:
    """docs and a struct column `to` (lang_pred, score, ambiguous) from the whole text alone, however long. A column of that
    name is replaced; all others stay. Null and empty texts and those without a letter are und, with score 0, and
    ambiguous. Repeated rows get equal results; equal losses go to the language that is first by name. With a model that
    learned nothing every row is und. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # N_FEATURES x bits of the code, 4 bytes each

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            parts = [shared.value.predict(texts.iloc[i : i + STEP].tolist()) for i in range(0, len(texts), STEP)]
            yield pd.DataFrame({"lang_pred": [n for p in parts for n in p[0]], "score": np.concatenate([p[1] for p in parts] or [[]]), "ambiguous": np.concatenate([p[2] for p in parts] or [[]]).astype(bool)})

    return docs.withColumn(to, of(F.col(text).cast("string")))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents whose fold is not 0; a null id has no fold and is held out of neither."""
    return docs.where(F.coalesce(fold(F.col(id_col)) != 0, F.lit(True)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those that the model rejects: no letter (null and empty texts among them), or ambiguous. The columns
    stay as they are, whatever their names, and so do repeated rows. Where no row is labelled nothing can be ambiguous:
    only texts without a letter go. An empty table gives no rows."""
    model = fit(training_rows(docs))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    mark = "__language"
    return identify(docs, model, to=mark).where(f"{mark}.lang_pred <> 'und' and not {mark}.ambiguous").drop(mark)


def op8_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    marked = identify(docs.drop("lang"), fit(training_rows(docs)))
    return marked.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")
