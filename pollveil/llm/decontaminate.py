"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased, with runs of white space as one blank. An item of m characters may occur
with up to k = EDIT_RATE * m edits. Each edit spoils at most q of its m - q + 1 q-grams, and an occurrence keeps within
2k + 1 diagonals (text position less item position). So a band of diagonals that holds an occurrence shares at least m + 1 - q (k + 1) q-grams with the
item. q is Q, or for short items the largest number that leaves the bound at one or more: m / (k + 1). Bands are
2 (2k + 1) wide and overlap by half; those that meet the bound are verified by banded alignment of the characters. The
filter loses no occurrence within the budget. Its q-grams are of one byte a character, which may only add candidates.

An item under WHOLE_WORDS characters (it may have no edits) counts where it stands as whole words: no letter, digit or
underscore may touch it.

Items come in blocks of about BLOCK_CHARS characters. A task holds the index of one block; a larger benchmark means more
passes over the texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm.common import stash, table

Q, EDIT_RATE = 8, 0.1
WHOLE_WORDS = 10
BLOCK_CHARS = 2_000_000
#: Text positions searched at once, besides an overlap that holds any occurrence.
CHUNK = 1 << 18
HASH_BITS = 22
#: Shared q-grams, and cells of alignments, that are held at once.
HITS, CELLS = 1 << 20, 1 << 18
MATCHES = "array<struct<item_id:string,start:int,end:int,edits:int,item_chars:int>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    """The characters as numbers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def codes(c: np.ndarray) -> np.ndarray:
    """A byte for each character, for q-grams; equal characters have equal bytes, and others may."""
    return ((c + (c >> 8) * 37) & 255).astype(np.uint8)


def windows(c: np.ndarray, q: int = Q) -> np.ndarray:
    """The q bytes from each position on, as one number."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([c, np.zeros(8 - q, np.uint8)])
    return np.ndarray((n,), "<u8", np.ascontiguousarray(padded), strides=(1,)) & np.uint64((1 << 8 * q) - 1)


def budget(m: int, rate: float = EDIT_RATE) -> int:
    """Edits that an item of m characters may have; one q-gram of it must survive them."""
    return min(int(rate * m), max(0, m - 1))


def gram_size(m: int, k: int) -> int:
    return max(1, min(Q, m // (k + 1)))


def align(item: np.ndarray, text: np.ndarray, base: np.ndarray, step: int, size: np.ndarray, at: np.ndarray, k: int, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between item and stretches of text along bands of diagonals, and where they end, for many bands at
    once (rows). Character j of a band's text, from 1 to its size, is text[base + step * j]; at: its diagonals, as many in
    each row, of which only these are looked at. anchored: the stretch begins at 0. More than k edits: (k + 1, -1)."""
    far = k + 1
    rank = np.arange(at.shape[1])
    size, base = size[:, None], base[:, None]
    row = np.where((at >= 0) & (at <= size), np.minimum(at, far) if anchored else 0, far)
    edge = np.full((len(at), 1), far)
    for i in range(1, len(item) + 1):
        j = at + i
        inside = (j >= 1) & (j <= size)
        other = text[np.where(inside, base + step * j, 0)] != item[i - 1]
        diagonal = np.where(inside, row + other, far)
        up = np.concatenate([row[:, 1:], edge], axis=1) + 1
        row = np.minimum(diagonal, np.where(j >= 0, up, far))
        row = np.where(j == 0, np.minimum(row, i), row)
        row = np.minimum(np.minimum.accumulate(row - rank, axis=1) + rank, far)
        row[(j < 0) | (j > size)] = far
        if row.min() >= far:
            break
    best = row.argmin(axis=1)
    edits = row[np.arange(len(row)), best]
    return edits, np.where(edits <= k, at[np.arange(len(row)), best] + len(item), -1)


@dataclass
class Found:
    item: int
    start: int
    end: int
    edits: int


class Grams:
    """The q-grams of items that have one q."""

    def __init__(self, q: int, own: list[tuple[int, str]], rate: float):
        """own: each item's number and normal text."""
        self.q, self.number, self.texts = q, [i for i, _ in own], [t for _, t in own]
        self.points = [points(t) for t in self.texts]
        self.m = np.array([len(c) for c in self.points], np.int64)
        self.k = np.array([budget(m, rate) for m in self.m.tolist()], np.int64)
        self.need = self.m + 1 - q * (self.k + 1)
        grams = [windows(codes(c), q) for c in self.points]
        gram = np.concatenate(grams)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(gram, kind="stable")
        self.item, self.pos = item[order].astype(np.int32), pos[order].astype(np.int32)
        self.gram, self.first = np.unique(gram[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(gram)))
        self.maybe = np.zeros(1 << HASH_BITS, bool)
        self.maybe[self._hash(self.gram)] = True
        self.overlap = int(2 * (self.m + self.k).max() + 8 * (self.k.max() + 1) + q)

    @staticmethod
    def _hash(gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)

    def places(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each q-gram of a text that items have as well: its position, its place in `gram`, and a running sum of how
        often items have it."""
        w = windows(c, self.q)
        at = np.nonzero(self.maybe[self._hash(w)])[0]
        place = np.minimum(np.searchsorted(self.gram, w[at]), len(self.gram) - 1)
        same = self.gram[place] == w[at]
        return at[same], place[same], np.cumsum(self.count[place[same]])

    def shared(self, at: np.ndarray, place: np.ndarray, upto: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item, its position and the text's position for each q-gram that a text and an item share; HITS of them at a time
        (or those of one position), since a repetitive text and a repetitive item share the product of their repeats."""
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(upto, (int(upto[a - 1]) if a else 0) + HITS, "right")))
            n = self.count[place[a:b]]
            entry = np.repeat(self.first[place[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield self.item[entry], self.pos[entry], np.repeat(at[a:b], n)
            a = b

    def bands(self, c: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(item, lowest diagonals) of the bands of 2 (2k + 1) diagonals that share enough q-grams."""
        hits = self.places(c)
        if not len(hits[0]):
            return []
        once = list(self.shared(*hits)) if hits[2][-1] <= HITS else None
        # First wide overlapping stripes, counted without sorting; few hits are left after that.
        stripe = max(256, 2 * int(self.k.max()) + 1)
        shift = int(self.m.max()) + 2 * stripe
        n_stripes = (len(c) + shift) // stripe + 2
        total = [np.zeros(len(self.m) * n_stripes + 2, np.int64) for _ in range(2)]
        key = lambda item, diagonal, offset: item.astype(np.int64) * n_stripes + (diagonal + shift + offset) // stripe
        for item, pos, at in once or self.shared(*hits):
            for half, offset in enumerate((0, stripe // 2)):
                found = np.bincount(key(item, at - pos, offset))
                total[half][: len(found)] += found
        near = [t + np.maximum(np.concatenate([[0], t[:-1]]), np.concatenate([t[1:], [0]])) for t in total]  # stripes 2 wide at steps of 1
        n_bands, longest = (len(c) + shift) + 2, int(self.m.max()) + 1
        rows = np.zeros(0, np.int64)  # (item, band, position), each once
        held: list[np.ndarray] = []
        size = 0
        for item, pos, at in once or self.shared(*hits):
            diagonal = at - pos
            keep = np.zeros(len(item), bool)
            for half, offset in enumerate((0, stripe // 2)):
                keep |= near[half][key(item, diagonal, offset)] >= self.need[item]
            item, pos, diagonal = item[keep].astype(np.int64), pos[keep].astype(np.int64), diagonal[keep]
            if not len(item):
                continue
            band = (diagonal + shift) // (2 * self.k[item] + 1)
            held += [np.unique((np.concatenate([item, item]) * n_bands + np.concatenate([band, band - 1])) * longest + np.concatenate([pos, pos]))]
            size += len(held[-1])
            if size > 4 * HITS:
                rows, held, size = np.unique(np.concatenate([rows, *held])), [], 0
        rows = np.unique(np.concatenate([rows, *held])) if held else rows
        owner, n = np.unique(rows // longest, return_counts=True)
        item, band = owner // n_bands, owner % n_bands
        good = n >= self.need[item]
        item, band = item[good], band[good]
        low = band * (2 * self.k[item] + 1) - shift
        return [(int(i), low[item == i]) for i in np.unique(item)]

    def verify(self, c: np.ndarray, text: str, item: int, lows: np.ndarray) -> list[Found]:
        """The best occurrence in each band, where there is one within the budget."""
        m, k = int(self.m[item]), int(self.k[item])
        width, out, rest = 2 * (2 * k + 1), [], []
        for low in lows.tolist():
            a, b = max(0, low), min(len(c), low + width - 1 + m + k)
            if a < b:
                at = text.find(self.texts[item], a, b)
                if at >= 0:  # no edits: the alignment would find the same
                    out.append(Found(self.number[item], at, at + m, 0))
                else:
                    rest.append(low)
        if not k:
            return out
        step = max(1, CELLS // width)
        for s in range(0, len(rest), step):
            low = np.array(rest[s : s + step], np.int64)
            begin = np.maximum(0, low)
            end = np.minimum(len(c), low + width - 1 + m + k)
            own = low - begin  # diagonals in the band's own text
            edits, stop = align(self.points[item], c, begin - 1, 1, end - begin, own[:, None] + np.arange(width), k)
            ok = edits <= k
            begin, stop, edits = begin[ok], (begin + stop)[ok], edits[ok]
            if len(stop):
                around = np.broadcast_to(np.arange(-k, k + 1), (len(stop), 2 * k + 1))
                _, length = align(self.points[item][::-1], c, stop, -1, stop - begin, around, k, anchored=True)
                out += [Found(self.number[item], int(e - n), int(e), int(x)) for e, n, x in zip(stop, length, edits, strict=True)]
        return out

    def find(self, text: str, c: np.ndarray, small: np.ndarray) -> list[Found]:
        out = []
        for base in range(0, max(0, len(c) - self.q + 1), CHUNK):
            to = base + CHUNK + self.overlap
            bands = self.bands(small[base:to])
            if bands:
                part, own = text[base:to], c[base:to]
                got = [f for i, lows in bands for f in self.verify(own, part, i, lows)]
                out += [Found(f.item, f.start + base, f.end + base, f.edits) for f in got]
        return out


class Index:
    """A block of items. Null and blank ones are left out."""

    def __init__(self, ids: list, texts: list[str | None], rate: float = EDIT_RATE, whole_words: int = WHOLE_WORDS):
        self.whole_words = whole_words
        own = [(i, t) for i, t in ((i, normal(t)) for i, t in zip(ids, texts, strict=True)) if t]
        self.ids, self.m, self.k = [i for i, _ in own], [len(t) for _, t in own], [budget(len(t), rate) for _, t in own]
        by_q: dict[int, list[tuple[int, str]]] = {}
        for n, (_, t) in enumerate(own):
            by_q.setdefault(gram_size(self.m[n], self.k[n]), []).append((n, t))
        self.grams = [Grams(q, of, rate) for q, of in sorted(by_q.items())]

    def find(self, text: str | None) -> list[Found]:
        """Occurrences of items in a normal text: of those that overlap, that with the fewest edits."""
        text = text or ""
        c = points(text)
        small = codes(c)
        out = [f for g in self.grams for f in g.find(text, c, small)]
        out = [f for f in out if self.m[f.item] >= self.whole_words or not (_INSIDE.match(text[f.start - 1 : f.start]) or _INSIDE.match(text[f.end : f.end + 1]))]
        kept: list[Found] = []
        last: dict[int, list[Found]] = {}
        for f in sorted(out, key=lambda f: (f.edits, f.start, f.item)):
            if all(f.end <= g.start or f.start >= g.end for g in last.get(f.item, ())):
                kept.append(f)
                last.setdefault(f.item, []).append(f)
        return sorted(kept, key=lambda f: (f.start, f.item))


_WORD, _INSIDE = re.compile(r"\S+"), re.compile(r"\w")


def places(raw: str, found: list[Found]) -> list[tuple[int, int]]:
    """Stretches of the raw text that stretches of its normal form stand for."""
    n, at, out = 0, [], []
    for w in _WORD.finditer(raw):
        size = len(w[0].lower())
        at.append((n, w.start(), size))
        n += size + 1
    starts = np.array([a for a, _, _ in at])
    for f in found:
        ends = []
        for x, tail in ((f.start, 0), (max(f.start, f.end - 1), 1)):
            a, begin, size = at[int(np.searchsorted(starts, x, "right")) - 1]
            ends.append(begin + min(x - a, size) + tail)
        out.append((ends[0], min(len(raw), ends[1])))
    return out


def matcher(shared: Broadcast):
    """A column function: text -> MATCHES, with offsets in the raw text. shared: the Index of one block of items, about
    BLOCK_CHARS characters."""

    @F.pandas_udf(MATCHES)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for batch in texts:
            rows = []
            for raw in batch:
                found = index.find(normal(raw))
                rows.append([{"item_id": index.ids[f.item], "start": s, "end": e, "edits": f.edits, "item_chars": int(index.m[f.item])} for f, (s, e) in zip(found, places(raw, found) if found else [], strict=True)])
            yield pd.Series(rows, dtype=object)

    return of.asNondeterministic()  # else the optimizer has it run once more to filter empty arrays


def blocks(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE, whole_words: int = WHOLE_WORDS) -> Iterator:
    """For each block of items a column function (text -> MATCHES, ids as text), whether it is the last, and what gives its
    index back; none where the benchmark has no text."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first().n
    n = -(-chars // BLOCK_CHARS)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").collect()  # a block
        shared = docs.sparkSession.sparkContext.broadcast(Index([r.i for r in rows], [r.t for r in rows], rate, whole_words))
        yield matcher(shared), b == n - 1, shared.unpersist


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", rate: float = EDIT_RATE, whole_words: int = WHOLE_WORDS) -> DataFrame:
    """doc_id, item_id, start, end (characters of the text), edits, item_chars: a row for each occurrence.

    Null and empty texts have none; null and blank items match nothing; texts are searched whole, however long. Repeated
    documents and repeated items give their rows each; ids may be of any type that has a text. Of overlapping occurrences of
    an item that with the fewest edits counts, of equals the first. Empty tables give no rows; other columns are not
    looked at. Items of fewer than `whole_words` characters count as whole words only. With several blocks of items, what each finds is written before
    the next one's index is made."""
    own, kind = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")), dict(benchmark.dtypes)["item_id"]
    found = own.select("doc_id", F.lit(None).cast(MATCHES).alias("m")).where("false").select("doc_id", F.inline("m"))
    for k, (of, last, done) in enumerate(blocks(docs, benchmark, rate=rate, whole_words=whole_words)):
        more = own.select("doc_id", of(F.col("text")).alias("m")).select("doc_id", F.inline("m"))
        if k or not last:
            more = stash(more)
            done()
        found = found.unionAll(more) if k else more
    return found.withColumn("item_id", F.col("item_id").cast(kind))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", whole_words: int = WHOLE_WORDS) -> DataFrame:
    """docs without those in which an item of the benchmark occurs. The columns stay as they are, whatever their names.

    Documents with null or empty text stay, repeated ones as often as they are there; an empty benchmark drops none.
    With several blocks of items, what each leaves is written before the next block's pass."""
    mark, kept = "__matches", docs
    for of, last, done in blocks(docs, benchmark, whole_words=whole_words):
        kept = kept.withColumn(mark, of(F.col(text).cast("string"))).where(F.size(mark) == 0).drop(mark)
        if not last:
            kept = stash(kept)
            done()
    return kept


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
