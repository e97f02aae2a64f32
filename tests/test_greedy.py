"""Greedy choices over rankings that stay in Spark, held against plain loops."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pollveil.operators import balance as B
from pollveil.operators import explore as X
from pollveil.plans.model import Layout

WIDE = Layout.of([(f"K{c}", f"{x}") for c in range(7) for x in "AB"])


def plain_cover(pool, needs, counts, k):
    """One pick after another over all ballots."""
    needs, counts, picked = dict(needs), {c: Counter(x) for c, x in counts.items()}, []
    left = {r.sig: r.n for r in pool}
    pool = sorted(pool, key=lambda r: (r.style_ord, r.ord))
    votes = {r.ord: {c: [WIDE.choice_name(i) for i in own if r.cells[i] not in ("", "0")] for c, own in WIDE.contests.items() if any(r.cells[i] for i in own)} for r in pool}
    gap = lambda c: 2 * max(c.values(), default=0) - sum(c.values())
    while needs:
        best, memo = None, {}
        for r in pool:
            if left[r.sig] <= k:
                continue
            own = tuple((c, tuple(v)) for c, v in votes[r.ord].items() if c in needs)
            if not own:
                continue
            if own not in memo:
                memo[own] = 10 * len(own) + sum(max(0, gap(counts.get(c, Counter())) - gap(counts.get(c, Counter()) + Counter(v))) for c, v in own if v)
            if best is None or memo[own] > best[0]:
                best = memo[own], r
        if best is None:
            break
        r = best[1]
        picked.append(r.ord)
        pool.remove(r)
        left[r.sig] -= 1
        for c, v in votes[r.ord].items():
            counts[c] = counts.get(c, Counter()) + Counter(v)
            if c in needs:
                needs[c] -= 1
                if not needs[c]:
                    del needs[c]
    return picked


def random_pool(spark, n, styles, seed):
    rng = random.Random(seed)
    rows, first, size = [], {}, Counter()
    on = {s: [c for c in range(7) if rng.random() < 0.5] for s in range(styles)}
    for i in range(1, n + 1):
        s = rng.randrange(styles)
        cells = [""] * 14
        for c in on[s]:
            a = rng.random()
            cells[2 * c], cells[2 * c + 1] = ("1", "0") if a < 0.7 else ("0", "1") if a < 0.9 else ("0", "0") if a < 0.97 else ("1", "1")
        first.setdefault(s, i)
        size[s] += 1
        rows.append((i, f"{s:06d}", cells, s))
    return spark.createDataFrame([(i, sig, cells, first[s], size[s]) for i, sig, cells, s in rows], "ord long, sig string, cells array<string>, style_ord long, n long")


@pytest.mark.parametrize(("seed", "head"), [(0, 1), (1, 5), (2, 40), (3, 2000)])
def test_coverage_equals_the_plain_loop(spark, seed, head):
    pool = random_pool(spark, 300, 25, seed).cache()
    needs, counts = {"K0": 6, "K2": 3, "K5": 9}, {"K0": {"A": 9, "B": 2}, "K2": {"B": 3}, "K5": {"A": 4}}
    assert B.cover_contests(pool, WIDE, needs, counts, 8, head) == plain_cover(pool.collect(), needs, counts, 8)


def test_coverage_over_more_classes_than_a_head(spark):
    pool = random_pool(spark, 40_000, 3000, 7).cache()
    assert pool.select("sig", "cells").distinct().count() > 20_000
    needs, counts = {f"K{c}": 60 + 10 * c for c in range(4)}, {"K0": {"A": 40}, "K1": {"B": 7}}
    picked, jobs = B._cover(pool, WIDE, needs, counts, 10, 500)
    assert picked == plain_cover(pool.collect(), needs, counts, 10) and len(picked) > 80
    assert jobs <= 20, (jobs, len(picked))  # of 27,000 classes: 17 for 90 picks


def historical(rows, winners):
    """The rule as it reads, over the whole ranking."""
    needed, out = set(winners), []
    for r in rows:
        if needed & set(r.satisfied):
            out.append(r.ord)
            needed -= set(r.satisfied)
            if not needed:
                have = Counter(c for x in rows[: len(out)] for c in x.satisfied)
                needed = {c for c in winners if have[c] < 3}
                if not needed:
                    break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_compat_contrast_equals_the_rule(spark, monkeypatch, seed):
    monkeypatch.setattr(B, "LEAST_RANGE", 1 + seed * 4)
    rng = random.Random(seed)
    winners = {f"K{c}": "A" for c in range(rng.randrange(1, 6))}
    names = [*winners][: max(1, len(winners) - seed % 2)]  # of some contests there may be no ballot
    rows = []
    for i in range(200):
        own = sorted(rng.sample(names, rng.randint(1, len(names)) if rng.random() < 0.2 else 1))
        rows.append((i, rng.randrange(6), own, len(own), "s", 50))
    scored = spark.createDataFrame(rows, "ord long, style_ord long, satisfied array<string>, score int, sig string, n long")
    ranked = scored.orderBy(F.desc("score"), "style_ord", "ord").collect()
    assert B.pick_contrast(scored, winners, 10, "compat") == historical(ranked, winners)


def test_no_ranked_ballots(spark):
    none = spark.createDataFrame([], "ord long, style_ord long, satisfied array<string>, score int, sig string, n long")
    assert B.pick_contrast(none, {"K0": "A"}, 10, "compat") == [] == B.pick_contrast(none, {"K0": "A"}, 10, "spec")


@pytest.mark.parametrize("seed", range(3))
def test_columns_of_ragged_signatures(spark, seed):
    rng = random.Random(seed)
    base = [rng.randrange(4) for _ in range(12)]
    sigs = set()
    for _ in range(300):
        seen = [rng.choice("01") for _ in range(4)]
        sigs.add("".join(seen[b] for b in base)[: rng.randrange(6, 13)])
    df = spark.createDataFrame([(s,) for s in sigs] * 2, "sig string").repartition(5)
    pairs = Counter((i, j, s[i] + s[j]) for s in sigs for i in range(len(s)) for j in range(len(s)))
    assert {(r.i, r.j, r.pair): r.n for r in X.column_cooccurrence(df).collect()} == dict(pairs)
    ordered, columns = sorted(sigs), {}
    for i in range(12):
        columns.setdefault(tuple(s[i] if i < len(s) else None for s in ordered), []).append(i)
    want = {(own[0], len(own), sum(b == "1" for b in v), sum(b is not None for b in v)) for v, own in columns.items() if any(b is not None for b in v)}
    assert {tuple(r) for r in X.column_groups(df).select("first_col", "n", "ones", "styles").collect()} == want
