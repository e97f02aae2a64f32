"""The entropy rule and contest-level redaction, held against brute force on small cases."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pollveil.operators import entropy as E
from pollveil.operators import release as R
from pollveil.operators import suppress as U
from pollveil.operators import tally as T
from pollveil.plans.model import Config
from tests.test_greedy import WIDE, random_pool
from tests.test_release import TWO, make


def plain_pick(pool, lacking, k):
    missing, left, out = {x: n for x, n in lacking.items() if n > 0}, {r.sig: r.n for r in pool}, []
    pool = sorted(pool, key=lambda r: (r.style_ord, r.ord))
    helps = {r.ord: {(c, WIDE.choice_name(i)) for c, own in WIDE.contests.items() for i in own if r.cells[i] == "1"} for r in pool}
    while missing:
        found = [(-len(helps[r.ord] & set(missing)), r.style_ord, r.ord, r) for r in pool if left[r.sig] > k and helps[r.ord] & set(missing)]
        if not found:
            break
        r = min(found, key=lambda x: x[:3])[3]
        out.append(r.ord)
        pool.remove(r)
        left[r.sig] -= 1
        for x in helps[r.ord] & set(missing):
            missing[x] -= 1
            if not missing[x]:
                del missing[x]
    return out, missing


@pytest.mark.parametrize(("seed", "head"), [(0, 1), (1, 7), (2, 2000)])
def test_picks_equal_the_plain_loop(spark, seed, head):
    pool = random_pool(spark, 200, 20, seed).cache()
    lacking = {("K0", "A"): 3, ("K0", "B"): 3, ("K3", "B"): 2, ("K5", "A"): 1, ("K6", "B"): 30, ("K1", "A"): 0}
    picked, unmet = E.pick(pool, WIDE, lacking, 8, head)
    assert (picked, unmet) == plain_pick(pool.collect(), lacking, 8)
    assert set(unmet) <= {("K6", "B")} and len(picked) >= 3


def test_requirements(spark):
    rows = [("r", "s", ["1", "0", "", ""])] + [(f"{i}", "s", ["1", "0", "1", "0"]) for i in range(7)] + [("x", "s", ["0", "1", "0", "1"]), ("y", "s", ["0", "1", "", ""])]
    b = make(spark, rows, 4)
    got = {(r.contest, r.choice): (r.total, r.required, r.held, r.missing) for r in E.requirements(b, b.where("cvr_number in ('r', '0')"), TWO).collect()}
    assert got == {("X", "A"): (8, 3, 2, 1), ("X", "B"): (2, 2, 0, 2), ("Y", "A"): (7, 3, 1, 2)}  # Y B has an eighth of the votes
    assert E.requirements(b, b.where("cvr_number = 'r'"), TWO).where("contest = 'Y'").count() == 0
    assert E.pick(b.where("false").selectExpr("*", "'s' as sig", "1L as style_ord", "1L as n"), TWO, {("X", "A"): 1}, 3) == ([], {("X", "A"): 1})


@pytest.mark.parametrize("mode", ["spec", "compat"])
def test_a_release_meets_the_rule_or_says_what_it_lacks(spark, mode):
    rows = [(f"r{i}", "s", ["1", "0", "1", "0"]) for i in range(4)] + [(f"d{i}", "s", ["0", "1", "", ""]) for i in range(9)] + [(f"e{i}", "s", ["", "", *(("0", "1") if i % 2 else ("1", "0"))]) for i in range(9)]
    own = make(spark, rows, 4)
    k = 5
    out = R.anonymize(own, TWO, Config(min_ballots=k, mode=mode, entropy=True))
    members = own.join(out.membership.where("bucket <> 'released'"), "ord")
    missing = {(r.contest, r.choice): r.missing for r in E.requirements(own, members, TWO).collect() if r.missing}
    assert missing == out.stats["entropy_unmet"] == {}
    assert out.stats["ballots_added_for_entropy"] == out.membership.where("bucket = 'entropy'").count()
    assert not T.verify(own, out.output, TWO).where("difference <> 0").count()


def tables(rows, hidden, styles, choices, shown_styles, shown_choices, most):
    """All tables that agree with what is shown: cells not in `hidden`, and the totals that are shown."""
    free = sorted(hidden)
    value = dict(rows)
    out = []

    def fill(i):
        if i == len(free):
            if all(sum(value[s, c] for c in choices) == n for s, n in shown_styles.items()) and all(sum(value[s, c] for s in styles) == n for c, n in shown_choices.items()):
                out.append(tuple(value[x] for x in free))
            return
        s, c = free[i]
        later = set(free[i + 1 :])
        limit = most
        if s in shown_styles:
            rest = shown_styles[s] - sum(value[s, x] for x in choices if (s, x) not in later and x != c)
            limit = min(limit, rest)
        if c in shown_choices:
            limit = min(limit, shown_choices[c] - sum(value[x, c] for x in styles if (x, c) not in later and x != s))
        for v in range(limit + 1):
            value[s, c] = v
            fill(i + 1)
        value[s, c] = rows[s, c]

    fill(0)
    return free, out


@pytest.mark.parametrize("seed", range(4))
def test_no_hidden_cell_is_bounded_tighter_than_the_minimum(spark, seed):
    rng, k, styles, choices = random.Random(seed), 3, ["s1", "s2", "s3"], ["a", "b", "c"]
    cases = {f"T{t}": {(s, c): rng.choice([0, 0, 1, 2, 3, 4, 5]) if t % 3 else rng.choice([0, 1, 2, 4]) for s in styles for c in choices} for t in range(25)}
    cases |= {"few": {(s, c): int(s == "s1" and c == "a") for s in styles for c in choices}, "none": {(s, c): 0 for s in styles for c in choices}}
    df = spark.createDataFrame([(t, s, c, n) for t, own in cases.items() for (s, c), n in own.items()], "contest string, style string, choice string, votes long")
    got = U.suppress(df, k).collect()
    assert len(got) == len(cases) * (9 + 3 + 3)
    seen = Counter()
    for t, own in cases.items():
        rows = [r for r in got if r.contest == t]
        assert all(r.votes == (own[r.style, r.choice] if r.kind == "cell" else sum(n for (s, c), n in own.items() if r.style in (None, s) and r.choice in (None, c))) for r in rows if r.votes is not None)
        cells = {(r.style, r.choice): r for r in rows if r.kind == "cell"}
        assert all(r.votes is None for x, r in cells.items() if 0 < own[x] < k)
        if any(r.reason == "contest" for r in rows):
            assert all(r.votes is None for r in rows)
            seen["contest"] += 1
            continue
        hidden = {x for x, r in cells.items() if r.votes is None}
        shown_styles = {r.style: r.votes for r in rows if r.kind == "style" and r.votes is not None}
        shown_choices = {r.choice: r.votes for r in rows if r.kind == "choice" and r.votes is not None}
        free, found = tables(own, hidden, styles, choices, shown_styles, shown_choices, 12)
        assert tuple(own[x] for x in free) in found
        for i, x in enumerate(free):
            values = [f[i] for f in found]
            assert max(values) - min(values) >= max(k, cells[x].width if len(shown_styles) + len(shown_choices) == 6 else k), (t, x, own, hidden)
        seen["hidden" if hidden else "shown"] += 1
        seen["totals"] += len(shown_styles) + len(shown_choices) < 6
    assert seen["hidden"] >= 5 and seen["contest"] >= 1 and seen["shown"] >= 1


def test_redaction_of_ballots(spark):
    rows = [(f"{i}", "s", ["1", "0", "1", "0"]) for i in range(6)] + [("x", "s", ["0", "1", "1", "0"])] + [(f"y{i}", "s", ["0", "1", "", ""]) for i in range(5)] + [(f"z{i}", "s", ["1", "0", "", ""]) for i in range(4)]
    styled = make(spark, rows, 4).withColumn("pattern", F.when(F.col("cells")[2] == "", "10").otherwise("11"))
    got = {(r.kind, r.contest, r.style, r.choice): r.votes for r in U.suppress(U.style_table(styled, TWO), 4).collect()}
    assert got["cell", "X", "11", "B"] is None and got["cell", "X", "11", "A"] is None and got["cell", "X", "10", "A"] is None
    assert got["choice", "X", None, "A"] == 10 and got["style", "X", "11", None] == 7 and got["cell", "Y", "11", "B"] == 0
    nothing = U.suppress(U.style_table(styled.where("false"), TWO), 4)
    assert nothing.count() == 0
