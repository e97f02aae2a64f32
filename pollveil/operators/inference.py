"""How well votes can be guessed: probabilities overall, by style, and through the release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollveil.functions import cells as C
from pollveil.operators import tally as T
from pollveil.plans.model import AGGREGATE_PREFIX, Layout
from pollveil.plans.store import cut, numbered


def in_style_order(ballots: DataFrame) -> DataFrame:
    """ballots with voter, numbered style by style in the order in which styles first appear, as the historical sheets
    number them."""
    first = ballots.groupBy("style").agg(F.min("ord").alias("__first"))
    own = ballots.withColumn("style", F.coalesce("style", F.lit(""))).join(first.withColumn("style", F.coalesce("style", F.lit(""))), "style")
    return numbered(own, "__first", "ord", to="voter").drop("__first")


def contest_picks(ballots: DataFrame, layout: Layout) -> DataFrame:
    """style, contest, pick for each contest on a ballot: the first column that is 1 (an overvote counts once), or null."""
    each = []
    for contest, own in layout.sorted_contests:
        voted = F.coalesce(*(F.when(C.is_one(F.get("cells", F.lit(i))), F.lit(i)) for i in own))
        each.append(F.struct(F.lit(contest).alias("contest"), voted.alias("pick"), C.any_present(F.col("cells"), own).alias("present")))
    return ballots.select("style", F.inline(F.array(*each))).where("present").drop("present")


def _shares(picks: DataFrame, layout: Layout, *by: str) -> DataFrame:
    columns = F.broadcast(layout.frame(picks.sparkSession))
    counted = cut(picks.groupBy(*by, "contest", F.col("pick").alias("col_idx")).agg(F.count("*").alias("votes")))  # one pass over ballots for all uses
    eligible = counted.groupBy(*by, "contest").agg(F.sum("votes").alias("eligible"))
    votes = counted.where("col_idx is not null")
    rows = eligible.join(columns, "contest").join(votes, [*by, "contest", "col_idx"], "left")
    votes = F.coalesce("votes", F.lit(0))
    return rows.select(*by, "contest", "choice", "col_idx", "eligible", votes.alias("votes"), (votes / F.col("eligible")).alias("prob"))


def overall_probabilities(ballots: DataFrame, layout: Layout) -> DataFrame:
    """contest, choice, col_idx, eligible, votes, prob, undervote (what no choice of the contest got)."""
    own = _shares(contest_picks(ballots, layout), layout)
    left = own.groupBy("contest").agg(((F.max("eligible") - F.sum("votes")) / F.max("eligible")).alias("undervote"))
    return own.join(left, "contest")


def style_probabilities(ballots: DataFrame, layout: Layout, min_ballots: int) -> DataFrame:
    """style, contest, choice, prob, ballot_count, is_common of single ballots; undervotes count as eligible."""
    sizes = ballots.groupBy("style").agg(F.count("*").alias("ballot_count"))
    return _shares(contest_picks(ballots, layout), layout, "style").join(sizes, "style").withColumn("is_common", F.col("ballot_count") >= min_ballots)


def aggregate_probabilities(aggregates: DataFrame, layout: Layout, min_ballots: int) -> DataFrame:
    """The same of aggregates: a choice's share of the contest's votes; the largest contest stands for the ballots."""
    own = T.long_cells(aggregates, layout, "style").withColumn("votes", F.coalesce(C.strip(F.col("cell")).try_cast("double").try_cast("bigint"), F.lit(0)))
    contests = own.groupBy("style", "contest").agg(F.sum("votes").alias("total"))
    sizes = contests.groupBy("style").agg(F.greatest(F.max("total"), F.lit(1)).alias("ballot_count"))
    rows = own.join(contests, ["style", "contest"]).join(sizes, "style")
    return rows.select("style", "contest", "choice", F.when(F.col("total") > 0, F.col("votes") / F.col("total")).otherwise(0.0).alias("prob"), "ballot_count", (F.col("ballot_count") >= min_ballots).alias("is_common"))


def marked_style(rows: DataFrame) -> DataFrame:
    """Released rows whose style is told by the style column or, where that is blank, by an aggregate's CVR number."""
    return rows.withColumn("style", F.when(C.strip(F.col("style")).startswith(AGGREGATE_PREFIX), C.strip(F.col("style"))).when(C.is_aggregate(F.col("cvr_number")), C.strip(F.col("cvr_number"))).otherwise(F.col("style")))


def style_mapping(original: DataFrame, released: DataFrame) -> DataFrame:
    """original_style, anonymized_style: itself where it was released, else the first aggregate, else nothing."""
    before, after = original.select("style").distinct(), released.select("style").distinct()
    aggregate = after.where(F.col("style").startswith(AGGREGATE_PREFIX)).agg(F.min("style").alias("aggregate"))
    rows = before.join(after.select(F.col("style").alias("kept")), F.col("style") == F.col("kept"), "left")
    first = aggregate.first().aggregate
    return rows.select(F.col("style").alias("original_style"), F.coalesce("kept", F.lit(first)).alias("anonymized_style")).where("anonymized_style is not null")


def ballot_probabilities(ballots: DataFrame, layout: Layout, overall: DataFrame, by_style: DataFrame | None = None, mapping: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """ord, style, probs: a row for each ballot, whether it has a contest or not. probs: contest, choice and prob of each
    column of a contest, the style's where by_style knows it, else the overall one; null where the contest is not on the
    ballot. Styles' probabilities come as one row a style, so that one join of ballots does. texts: with text, what sheets
    show of prob (else null), formatted once for each style and choice, not for each ballot."""
    every = {(r.contest, r.choice): r.prob for r in overall.select("contest", "choice", "prob").collect()}  # as wide as a ballot
    own = ballots.select("ord", "style", "cells")
    if mapping is not None:
        own = own.join(mapping, F.col("style") == F.col("original_style"), "left").withColumn("style", F.coalesce("anonymized_style", "style")).drop("original_style", "anonymized_style")
    if by_style is not None:
        one = by_style.groupBy("style", "contest", "choice").agg(F.max("prob").alias("prob"))
        text = C.format_probability(F.col("prob")) if texts else F.lit(None).cast("string")
        one = one.withColumn("text", text)
        known = one.groupBy("style").agg(F.map_from_entries(F.collect_list(F.struct(_key(F.col("contest"), F.col("choice")).alias("k"), F.struct("prob", "text").alias("v")))).alias("known"))  # as wide as a ballot
        own = own.join(known, "style", "left")
    each = []
    for contest, columns in layout.sorted_contests:
        present = C.any_present(F.col("cells"), columns)
        for i in columns:
            choice = layout.columns[i].choice
            prob, text = F.lit(every.get((contest, choice))).cast("double"), F.lit(C.probability_text(every.get((contest, choice))) if texts else None).cast("string")
            if by_style is not None:
                mine = F.try_element_at(F.col("known"), _key(F.lit(contest), F.lit(choice)))
                prob = F.when(F.col("known").isNotNull(), F.coalesce(mine.prob, F.lit(0.0))).otherwise(prob)
                text = F.when(F.col("known").isNotNull(), F.coalesce(mine.text, F.lit(C.probability_text(0.0)))).otherwise(text)
            each.append(F.struct(F.lit(contest).alias("contest"), F.lit(choice).alias("choice"), F.lit(i).alias("col_idx"), F.when(present, prob).alias("prob"), F.when(present, text).otherwise("").alias("text"), present.alias("present")))
    probs = F.array(*each) if each else F.expr("cast(array() as array<struct<contest:string,choice:string,col_idx:int,prob:double,text:string,present:boolean>>)")
    return own.select("ord", "style", probs.alias("probs"))


def _key(contest, choice):
    """A text that no other contest and choice have."""
    return F.concat(F.length(contest).cast("string"), F.lit(":"), contest, choice)


def probability_sheet(ballots: DataFrame, layout: Layout, overall: DataFrame, by_style: DataFrame | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """voter (by place), style, contest, choice, prob for each contest on the voter's ballot: the style's, else the
    overall probability."""
    own = ballot_probabilities(ballots, layout, overall, by_style, mapping, texts=False)
    rows = own.select("ord", "style", F.explode(F.filter("probs", lambda p: p.present)).alias("p"))
    return rows.select(_voter().alias("voter"), "style", "p.contest", "p.choice", "p.prob")


def _voter():
    return F.concat(F.lit("V"), F.col("ord").cast("string"))


def wide_sheet(own: DataFrame, layout: Layout) -> DataFrame:
    """ballot_probabilities as Voter, Style and a formatted column for each choice, blank where the contest is not on the
    ballot. Every voter has a row."""
    place = {i: n for n, i in enumerate(i for _, columns in layout.sorted_contests for i in columns)}
    columns = [(c.choice, F.get(F.col("probs"), F.lit(place[c.index])).text) for c in layout.columns if c.contest]
    return own.select(_voter().alias("Voter"), F.coalesce("style", F.lit("")).alias("Style"), *(p.alias(n) for n, p in columns))
