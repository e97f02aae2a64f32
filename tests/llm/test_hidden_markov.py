"""The language model's score held against a plain forward recursion over the words."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollveil.llm import hmm, isomedia

ROWS = [
    (1, "a b c a b c d e f g", False), (2, "A B rare1 rare2 c", False), (3, "", False), (4, None, False), (5, "x y z x y a", False), (6, "b b b w1 w2 w3 w4", False),
    (7, "a unknown b rare1 w3", True), (8, "unknown unknown Unknown2", True), (9, None, True), (9, "c d", True), (None, "e f rare2 never", True),
]


def plain_lexicon(head, known):
    seen = Counter(w for _, t, held in ROWS if not held for w in [*hmm.words(t), hmm.END])
    order = sorted(seen, key=lambda w: (-seen[w], w))
    totals = [0.5] * hmm.TAIL_CLASSES
    for w in order[head:]:
        totals[hmm.tail_class(w)] += seen[w] + 0.5
    return seen, order[:head], totals


@pytest.mark.parametrize(("head", "known"), [(4, 6), (3, 3), (100, 100), (6, 9)])
def test_score_equals_a_plain_forward_recursion(spark, monkeypatch, head, known):
    real = hmm.lexicon
    monkeypatch.setattr(hmm, "lexicon", lambda vocab: real(vocab, head, known))
    seen, heads, totals = plain_lexicon(head, known)
    mass = np.array([seen[w] for w in heads] + totals)
    model = []

    def fixed(coded, found):
        assert np.allclose(found, mass)
        model.append(hmm.first_parameters(found))
        return model[0]

    monkeypatch.setattr(hmm, "train", fixed)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, held_out boolean")
    got = {(r.doc_id, r.n_tokens): r for r in hmm.score(docs).collect()}
    assert len(got) == len(ROWS)
    (p,) = model
    n, v = sum(seen.values()), len(seen)
    for i, text, held in ROWS:
        own = [*hmm.words(text), hmm.END]
        alpha, total = p.start.tolist(), 0.0
        for t, w in enumerate(own):
            if t:
                alpha = [sum(alpha[a] * p.move[a, b] for a in range(hmm.STATES)) for b in range(hmm.STATES)]
            if w in heads:
                emit = p.emit[heads.index(w)]
            else:  # of its class, in proportion to its count
                emit = p.emit[len(heads) + hmm.tail_class(w)] * (seen.get(w, 0) + 0.5) / totals[hmm.tail_class(w)]
            alpha = [x * e for x, e in zip(alpha, emit.tolist(), strict=True)]
            total += math.log10(sum(alpha))
            alpha = [x / sum(alpha) for x in alpha]
        r = got[i, len(own)]
        assert r.held_out == held and r.n_known == sum(w in seen for w in own) and r.train_tokens == n
        assert abs(r.score - total) < 1e-9 and abs(r.base_score - sum(math.log10((seen.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-9


def test_a_grade_is_cut_inside(spark):
    vocab = spark.createDataFrame([(f"w{i:02d}".encode(), i % 3, 1) for i in range(40)] + [(b"top", 1, 9)], "word binary, class int, n long")
    for known in (1, 2, 17, 41, 60):
        lex, rest = hmm.lexicon(vocab, 5, known)
        assert list(lex.place) == [b"top", *(f"w{i:02d}".encode() for i in range(40))][:known]
        assert rest.count() == 41 - min(known, 41)


def test_sums_do_not_depend_on_the_packs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(0, 12, rng.integers(1, 30)).astype(np.uint16).tobytes()) for i in range(60)]
    docs = spark.createDataFrame(rows, "key long, symbols binary").repartition(7)
    mass, found = np.ones(12), []
    for pack in (256, 2):
        monkeypatch.setattr(hmm, "PACK", pack)
        found.append(hmm.one_round(docs, hmm.first_parameters(mass), mass))
    assert np.allclose(found[0][0].pack(), found[1][0].pack()) and abs(found[0][1] - found[1][1]) < 1e-6


def test_rounds_end_with_the_gain(monkeypatch, spark):
    coded = spark.createDataFrame([(1, 10, False, b"\0\0" * 10)], "doc_id long, n_tokens long, held_out boolean, symbols binary").withColumn("key", F.col("doc_id"))
    for gains, want in (([5.0, 4.0, 3.0], 3), ([5.0, 0.05, 3.0], 1), ([5.0, 4.0, 0.01], 2)):
        done = []

        def fake(docs, p, mass, gains=gains, done=done):
            done.append(p)
            full = len(done) - hmm.WARM_ROUNDS
            return full, sum(gains[:full]) if full > 0 else 0.0

        monkeypatch.setattr(hmm, "one_round", fake)
        assert hmm.train(coded, np.ones(3)) == want


def boxes(data):
    return {kind: (start, at, end) for kind, start, at, end in isomedia.walk(memoryview(data))}


def test_fields_beyond_their_box_end_in_an_error():
    whole = isomedia.mux(isomedia.pad(b"some text of a film"))
    assert isomedia.features(whole)["error"] is None
    for kind in (b"tkhd", b"mdhd"):
        start, at, end = boxes(whole)[kind]
        for keep in (0, 4, 8):  # the box ends early, and what follows is a free box
            cut = bytearray(whole)
            cut[start : start + 4] = (at - start + keep).to_bytes(4, "big")
            free = end - at - keep
            cut[at + keep : at + keep + 8] = free.to_bytes(4, "big") + b"free"
            assert isomedia.features(bytes(cut))["error"], (kind, keep)


def test_ranges_of_every_track_lie_in_the_file():
    whole = bytearray(isomedia.mux(isomedia.pad(b"film")))
    start, at, end = boxes(whole)[b"trak"]
    moov, _, moov_end = boxes(whole)[b"moov"]
    second = bytearray(whole[start:end])
    where = bytes(second).index(b"stco") + 12
    second[where : where + 4] = (2**31 - 1).to_bytes(4, "big")
    both = whole[:moov_end] + second + whole[moov_end:]
    both[moov : moov + 4] = (moov_end - moov + len(second)).to_bytes(4, "big")
    for first in (bytes(both), bytes(whole)):
        assert (isomedia.features(first)["error"] is None) == (first == bytes(whole))
    assert "beyond the file" in isomedia.features(bytes(both))["error"]
