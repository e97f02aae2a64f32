"""Decontamination of repetitive texts and by large benchmarks, and language identification with many labels."""

from __future__ import annotations

import time

import numpy as np
import pytest

from pollveil.llm import decontaminate, langid
from tests.llm.helpers import EDGES, documents


def least_edits(item, text):
    """Edits between item and the stretch of text nearest to it, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


REPETITIVE = [
    ("ab" * 100, "ab" * 10_000),
    ("a" * 200, "a" * 20_000),
    ("ab" * 50 + "x" + "ab" * 50, "ab" * 10_000),
    ("ab" * 90 + "q w e r t y u", ("ab" * 9 + " ") * 1000),
    ("the cat sat on the mat " * 9, "the cat sat on the mat " * 900),
    ("abcdefgh" * 25, ("abcdefgh" * 12 + "zzzz") * 200),
]


@pytest.mark.parametrize(("item", "text"), REPETITIVE)
def test_repetitive_texts_take_little_time(item, text):
    index = decontaminate.Index([1], [item])
    began = time.perf_counter()
    found = index.find(decontaminate.normal(text))
    assert time.perf_counter() - began < 3
    own, short = decontaminate.normal(item), decontaminate.normal(text[:1200])
    assert bool(index.find(short)) == (least_edits(own, short) <= decontaminate.budget(len(own))) == bool(found)
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize("hits", [1, 37, 1 << 20])
def test_hits_are_taken_in_parts(monkeypatch, hits):
    rng = np.random.default_rng(0)
    items = ["".join(rng.choice(list("ab "), 60)) for _ in range(4)] + ["ab" * 30]
    text = decontaminate.normal("".join(rng.choice(list("ab"), 900)) + " " + items[1] + "ab" * 60 + items[2][:30] + "x" + items[2][31:])
    want = decontaminate.Index(list(range(5)), items).find(text)
    monkeypatch.setattr(decontaminate, "HITS", hits)
    monkeypatch.setattr(decontaminate, "CELLS", hits)
    assert decontaminate.Index(list(range(5)), items).find(text) == want and {f.item for f in want} >= {1, 2, 4}


def test_blocks_of_items_and_text_ids(spark, monkeypatch):
    items = spark.createDataFrame([("one two", "one two three four five"), ("fox", "quick brown fox jumps over"), (None, "the lazy dog jumps"), ("blank", " "), ("none", None)], "item_id string, text string")
    docs = documents(spark, [r for r in EDGES if r[0] != 6])
    want = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    assert [r[:2] for r in want] == [(7, "fox"), (7, "fox"), (8, "fox")]
    kept = sorted(map(tuple, decontaminate.keep_clean(docs, items).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 15)
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == want
    assert sorted(map(tuple, decontaminate.keep_clean(docs, items).collect()), key=repr) == kept


def test_short_items_as_whole_words_is_a_parameter():
    text = "tyes we cano yes we can"
    assert [f.start for f in decontaminate.Index([1], ["yes we can"]).find(text)] == [1, 13]
    assert [f.start for f in decontaminate.Index([1], ["yes we can"], whole_words=11).find(text)] == [13]
    assert [f.start for f in decontaminate.Index([1], ["can"], whole_words=0).find(text)] == [8, 20]


@pytest.mark.parametrize("n", [257, 2000, 10_000])
def test_codes_of_many_languages(n):
    began = time.perf_counter()
    code = langid.code_matrix(n)
    assert len(np.unique(code, axis=0)) == n and code.shape[1] <= 15 * np.log2(n) + 1
    rows = np.random.default_rng(0).integers(0, n, 60)
    best, score, close = langid.decode(code[rows] * 0.5 + np.random.default_rng(1).normal(0, 0.2, (60, code.shape[1])), code)
    assert best.tolist() == rows.tolist() and score.min() > 0.9 and not close.any()
    assert time.perf_counter() - began < 10


def test_decoding_equals_the_sum_of_losses():
    code, m = langid.code_matrix(9), np.random.default_rng(2).normal(0, 0.05, (40, langid.code_matrix(9).shape[1]))
    m[0] = 0  # all equal: the first by name
    best, score, close = langid.decode(m, code)
    for r in range(40):
        loss = [sum(np.log1p(np.exp(-langid.SCALE * x * b)) for x, b in zip(m[r], row, strict=True)) for row in code.tolist()]
        order = np.argsort(np.round(loss, 9), kind="stable")
        assert best[r] == order[0] and abs(score[r] - 1 / sum(np.exp(loss[order[0]] - x) for x in loss)) < 1e-9
        assert close[r] == ((loss[order[1]] - loss[order[0]]) / code.shape[1] < langid.AMBIGUOUS)


def test_two_thousand_labels_are_learned(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(2000)]
    rows = [(10 * i + k, " ".join([words[i]] * 12), f"l{i:04d}", None) for i in range(2000) for k in range(2)]
    docs = documents(spark, rows)
    model = langid.fit(docs)
    got = langid.identify(docs.where("doc_id % 10 = 0"), model).select("doc_id", "language.lang_pred").collect()
    assert len(model.languages) == 2000 and sum(r.lang_pred == f"l{r.doc_id // 10:04d}" for r in got) > 1900
