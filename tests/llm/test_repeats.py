"""Runs of periodic words, held against plain loops."""

from __future__ import annotations

import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pollveil.llm import queries, repeats
from tests.llm.helpers import EDGES, SF, documents


def plain_runs(c, min_words=6, min_periods=4):
    out = []
    for q in range(1, len(c) // min_periods + 1):
        equal = [c[i] == c[i + q] for i in range(len(c) - q)]
        i = 0
        while i < len(equal):
            j = i
            while j < len(equal) and equal[j]:
                j += 1
            length = j - i + q
            if length >= max(min_words, min_periods * q) and not any(all(c[k] == c[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words, h = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(words, own):
    gone = {i for s, n, q in own for i in range(s + q, s + n)}
    best = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(own), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


sequences = st.one_of(
    st.lists(st.integers(0, 1), max_size=40),
    st.lists(st.integers(0, 3), max_size=40),
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 8), st.lists(st.integers(0, 3), max_size=5)).map(lambda x: x[2] + x[0] * x[1] + x[2]),
)


@settings(max_examples=400, deadline=None)
@given(sequences)
def test_vocabulary_and_runs_equal_plain_loops(c):
    tree, marks = repeats.vocabulary(np.array(c, np.int64))
    got = [tuple(c[tree.sa[tree.low[v]] : tree.sa[tree.low[v]] + n]) for v, n in marks]
    want = {tuple(c[i : i + 2 * q]) for q in range(1, len(c) // 2 + 1) for i in range(len(c) - 2 * q + 1) if c[i : i + q] == c[i + q : i + 2 * q]}
    assert len(got) == len(set(got)) and set(got) == want
    for how in ((6, 4), (2, 2), (5, 3)):
        assert [tuple(r) for r in repeats.runs(np.array(c, np.int64), *how).tolist()] == plain_runs(c, *how)


@settings(max_examples=150, deadline=None)
@given(st.lists(sequences, min_size=1, max_size=4), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_the_first_pass_loses_no_run(cs, how):
    texts = [" ".join(map(str, c)) for c in cs] + [None, ""]
    words, found = repeats._batch(texts, *how)
    assert [len(w) for w in words] == [*map(len, cs), 0, 0]
    assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(c, *how) for c in cs] + [[], []]


def test_long_periodic_texts_take_time_in_proportion():
    for c in (np.zeros(60_000, np.int64), np.random.default_rng(0).integers(0, 300, 60_000)[np.arange(60_000) % 9000]):
        began = time.perf_counter()
        assert len(repeats.runs(c)) == 1
        assert time.perf_counter() - began < 15


RUNS = [
    (31, "la la la la la la la", None, None),
    (32, "x a b a b a b a b y", None, None),
    (33, "a\tb\na  b\x0ba b\ra b", None, None),
    (34, "A a A a A a A a", None, None),
    (35, "a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca", None, None),
    (36, " ".join(["one two"] * 4 + ["three"] * 7), None, None),
]


def test_rows_and_edges(spark):
    own = documents(spark, [r for r in EDGES + RUNS if r[1] is None or len(r[1]) < 1000])
    rows = repeats.periodic_runs(own).collect()
    texts = [(r.doc_id, r.text) for r in own.collect()]
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in texts]
    want = [(i, len(w), plain_runs(w), digest(w, plain_runs(w))[-1]) for (i, _), w in zip(texts, split, strict=True)]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], hashlib.sha256(r.collapsed.encode()).hexdigest()) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(len(r[2]) for r in got) >= 6
    nothing = repeats.periodic_runs(own.where("false"))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        repeats.periodic_runs(own, min_periods=1)


def test_a_long_text_is_one_run(spark):
    (row, again) = repeats.periodic_runs(documents(spark, [r for r in EDGES if r[0] == 6])).collect()
    assert row == again and [tuple(r) for r in row.runs] == [(0, 80_000, 4)] and row.collapsed == "alpha beta gamma delta"


def test_query_equals_plain_loops(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in own.collect()}
    rows = queries.QUERIES["op12_periodic_runs"](spark, SF).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert len(rows) == len(texts)
    some = 0
    for r in rows:
        words = planted(r.doc_id, texts[r.doc_id])
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        c = [numbers[w] for w in words]
        found = plain_runs(c) if len(c) < 700 else [tuple(x) for x in repeats.runs(np.array(c, np.int64)).tolist()]
        assert tuple(r)[1:] == digest(words, found)
        some += bool(found)
    assert some >= 10


def test_planting_stands_odd_texts(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    odd = [None, "", "  \t", "one", " a b\tc ", "x " * 50]
    own = documents(spark, [(i, odd[k % len(odd)], None, None) for k, i in enumerate(ids)] + [(None, "a b c", None, None)])
    got = {(r.doc_id, r.text) for r in repeats.with_planted_runs(own).collect()}
    assert {(i, tuple((t or "").encode().split())) for i, t in got} == {(r.doc_id, tuple(planted(r.doc_id, r.text))) for r in own.collect()}
