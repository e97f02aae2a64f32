"""What the hidden Markov model starts from: all training documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pollveil.llm import hmm


def test_every_training_document_counts_in_start_and_rounds(spark, monkeypatch):
    symbols = np.array([1, 2, 0], np.uint16).tobytes()
    coded = spark.range(6000).select(F.col("id").alias("key"), F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("n_tokens"), F.lit(False).alias("held_out"), F.lit(symbols).alias("symbols"))
    seen = []
    monkeypatch.setattr(hmm, "one_round", lambda docs, p, mass: (p, float(seen.append(docs.count()) or 0)))
    p = hmm.train(coded, np.ones(3))
    assert seen and set(seen) == {6000}
    assert np.allclose(p.emit.sum(axis=0), 1) and np.allclose(p.move.sum(axis=1), 1)
    ahead, behind = hmm.neighbours(coded, 3)
    assert ahead.sum() == behind.sum() == 12000 and ahead[1, 2] == ahead[2, 0] == behind[2, 1] == behind[0, 2] == 6000


def test_the_start_finds_words_that_stand_together():
    """Words of three groups that stand beside their like. First states stay as they are more often than not; groups that
    take turns need not be found from there."""
    rng = np.random.default_rng(5)
    group = np.arange(60) % 3
    pairs = rng.poisson(np.where(group[:, None] == group, 200.0, 5.0))
    mass, member = pairs.sum(axis=1).astype(float), np.eye(hmm.CONTEXTS)[hmm.contexts(60)]
    ahead, behind = pairs @ member, pairs.T @ member
    emit = hmm.fitted(hmm.first_parameters(mass, 3), ahead, behind, mass).emit
    best = emit.argmax(axis=1)
    assert sorted(best[:3]) == [0, 1, 2] and (best == best[group]).all()
