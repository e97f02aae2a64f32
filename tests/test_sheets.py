"""Sheets of probabilities: what is done once for a style, not for each ballot."""

from __future__ import annotations

from pollveil.operators import inference as I
from pollveil.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_sheet_runs_no_python_for_each_ballot(spark):
    assert "ArrowEvalPython" not in plan(queries.queries()["wide_sheet"](spark, SF))


def test_style_texts_follow_their_probabilities(spark):
    case = queries.Case(spark, SF, None, 10)
    own = case.by_signature()
    shares = I.style_probabilities(own, case.layout, 10).select("style", "contest", "choice", "prob")
    rows = I.ballot_probabilities(own, case.layout, I.overall_probabilities(own, case.layout), shares).selectExpr("inline(probs)").distinct().collect()
    assert len({r.text for r in rows}) > 10
    for r in rows:
        assert r.text == ("" if not r.present else "0.0000" if r.prob == 0 else "1.000" if r.prob >= 1 else f"{r.prob:.4f}"[:6])


def test_probability_sheet_counts_each_kind_of_shares_once(spark):
    """Ballots are exploded for the sheet alone: the counts behind the shares are stored, not made anew by each use."""
    assert plan(queries.queries()["probability_sheet"](spark, SF)).count("Generate explode") == 1
    case = queries.Case(spark, SF, None, 10)
    assert "Generate" not in plan(I.overall_probabilities(case.unordered, case.layout))
