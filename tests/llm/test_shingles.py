"""The near-duplicate stage against brute force."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from pollveil.llm import shingles, simhash
from tests.llm.helpers import EDGES, SF, documents


def plain_kept(rows):
    """Ids kept, by comparing all pairs of sets of five words."""
    sets = {}
    for r in rows:
        own = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {b" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i for i in ids if root[i] == i}


def test_near_dedup_has_the_recall_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(5000)]
    rows, line = [], " the same line in very many of the texts "
    for _ in range(40):
        base = list(rng.choice(words, int(rng.integers(3, 400))))
        for changed in (0, 0, 1, 2, 3, 5, 8):
            own = list(base)
            for at in rng.integers(0, len(own), changed):
                own[at] = str(rng.choice(words))
            rows.append((len(rows), " ".join(own).upper() + line * int(rng.integers(0, 2)), "en", "a"))
    docs = documents(spark, [rows[i] for i in rng.permutation(len(rows))])
    want = plain_kept(docs.collect())
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want
    monkeypatch.setattr(shingles, "SAMPLE", 0)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want


def test_near_dedup_of_one_large_cluster(spark):
    """Copies edited each on its own: similar to the original, few to each other; half the time the original is gone."""
    rng = np.random.default_rng(9)
    rows = []
    for keep_original in (True, False):
        base = [f"{keep_original}{i}" for i in rng.integers(0, 400, 150)]
        for k in range(150):
            own = list(base)
            for at in rng.integers(0, len(own), int(rng.integers(1, 4)) if k or not keep_original else 0):
                own[at] = f"x{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(own), "en", "a"))
    docs = documents(spark, [rows[i] for i in rng.permutation(len(rows))])
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == plain_kept(docs.collect())


def test_a_few_words_of_a_text_replaced(spark):
    text = [f"w{i}" for i in range(300)]
    other = [f"x{i}" if i % 75 == 5 else w for i, w in enumerate(text)]
    docs = documents(spark, [(1, " ".join(text), "en", "a"), (2, " ".join(other), "en", "a"), (3, " ".join(text[:200]), "en", "a")])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 3]


def test_near_dedup_at_the_edges(spark):
    docs = documents(spark, EDGES)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7]
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_near_dedup_of_long_texts(spark):
    """Sets with a second sketch, of lengths on both sides of a power of two, that share passages with each other."""
    rng = np.random.default_rng(3)
    passages = [[f"p{i}_{j}" for j in range(300)] for i in range(8)]
    rows = []
    for size in (900, 1030, 1900, 2040, 2100, 4090):
        base = [f"{size}_{i}" for i in range(size)]
        for k, changed in enumerate((0, 10, size // 60, size // 25, size // 8)):
            own = list(base)
            for at in rng.choice(len(own), changed, replace=False):
                own[at] = f"y{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(own[: len(own) - 15 * k] + passages[int(rng.integers(8))]), "en", "a"))
    for _ in range(20):
        rows.append((len(rows), " ".join([f"z{i}" for i in rng.integers(0, 1 << 40, 1200)] + passages[0] + passages[1]), "en", "a"))
    docs = documents(spark, [rows[i] for i in rng.permutation(len(rows))])
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == plain_kept(docs.collect())


def test_folded_sketches_differ_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(4)
    for _ in range(50):
        every = np.unique(rng.integers(0, 1 << 63, 2600).astype(np.uint64))
        a, b = every[: int(rng.integers(1100, 2600))], every[int(rng.integers(0, 300)) :]
        x, y = shingles.wide_sketch(a), shingles.wide_sketch(b)
        while len(x) != len(y):
            x, y = (v if len(v) == min(len(x), len(y)) else v[: len(v) // 2] ^ v[len(v) // 2 :] for v in (x, y))
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_near_copies_without_an_id(spark):
    text = [f"w{i}" for i in range(100)]
    other = " ".join("x" if i == 50 else w for i, w in enumerate(text))
    docs = documents(spark, [(None, " ".join(text), "en", "a"), (None, other, "en", "a"), (None, "something else that is quite short", "en", "a"), (5, other, "en", "a"), (5, " ".join(reversed(text)), "en", "a")])
    assert [r.doc_id for r in simhash.keep_one(docs).collect()].count(5) == 2
    assert simhash.keep_one(docs).count() == 3
