"""Sums and tallies of vote cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollveil.functions import cells as C
from pollveil.plans.model import Layout


def long_cells(ballots: DataFrame, layout: Layout, *keep: str, blank_names: bool = True, beyond: bool = True) -> DataFrame:
    """A row for each cell whose column belongs to a contest: keep.., col_idx, contest, choice, cell (Layout.frame)."""
    own = ballots.select(*keep, F.posexplode("cells").alias("col_idx", "cell"))
    return own.join(F.broadcast(layout.frame(ballots.sparkSession, blank_names, beyond)), "col_idx")  # as many rows as a ballot has columns


def column_sums(ballots: DataFrame) -> DataFrame:
    """col_idx, total: each vote column added up; columns without a number give 0. Partial sums before the shuffle."""
    own = ballots.select(F.posexplode("cells").alias("col_idx", "cell"))
    return own.groupBy("col_idx").agg(F.coalesce(F.sum(C.summand(F.col("cell"))), F.lit(0.0)).alias("total"))


def printed(total):
    """A sum as a cell: whole numbers without a point."""
    return F.when(total == F.floor(total), F.floor(total).cast("bigint").cast("string")).otherwise(total.cast("string"))


def tally(ballots: DataFrame, layout: Layout) -> DataFrame:
    """contest, choice, votes of ballots and aggregates; what has no vote is absent, and so are columns that the choices
    row does not reach."""
    own = long_cells(ballots, layout, C.is_aggregate(F.col("cvr_number")).alias("aggregate"), beyond=False)
    votes = C.vote_count(F.col("cell"), F.col("aggregate"))
    return own.withColumn("votes", votes).where("votes > 0").groupBy("contest", "choice").agg(F.sum("votes").alias("votes"))


def group_tally(ballots: DataFrame, layout: Layout, mode: str) -> DataFrame:
    """contest, choice, votes, first_col of a group that is to become an aggregate. spec counts its sums; compat counts
    a column only where its sum is exactly 1, as the historical temporary aggregate does."""
    own = column_sums(ballots).join(F.broadcast(layout.frame(ballots.sparkSession, beyond=False)), "col_idx")
    count = (F.col("total") == 1).cast("long") if mode == "compat" else F.col("total").cast("bigint")
    return own.withColumn("votes", count).where("votes > 0").groupBy("contest", "choice").agg(F.sum("votes").alias("votes"), F.min("col_idx").alias("first_col"))


def near_unanimous(totals: DataFrame) -> DataFrame:
    """contest, winner, winner_votes, total_votes where all votes but 2 at most go to one choice."""
    own = totals.groupBy("contest").agg(F.sum("votes").alias("total_votes"), F.max("votes").alias("winner_votes"), F.min_by("choice", F.struct(-F.col("votes"), F.col("first_col"))).alias("winner"))
    return own.where("total_votes > 0 and total_votes - winner_votes <= 2").select("contest", "winner", "winner_votes", "total_votes")


def verify(original: DataFrame, released: DataFrame, layout: Layout) -> DataFrame:
    """contest, choice, original, anonymized, difference: every pair that either has. All differences must be 0."""
    a, b = tally(original, layout).withColumnRenamed("votes", "a"), tally(released, layout).withColumnRenamed("votes", "b")
    own = a.join(b, ["contest", "choice"], "full_outer")
    x, y = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return own.select("contest", "choice", x.alias("original"), y.alias("anonymized"), (y - x).alias("difference"))


def conservation(long: DataFrame, ballots: DataFrame, layout: Layout) -> DataFrame:
    """contest, choice, long_votes, ballot_votes, difference: voters with a true row for each contest and candidate (names
    without white space around), against the tally of the ballots made of them. All differences must be 0."""
    names = [C.strip(F.col(c).cast("string")).alias(n) for c, n in (("contest", "contest"), ("candidate", "choice"))]
    true = long.where("isVote").select("voter_id", "contest", "candidate").distinct().groupBy(*names).agg(F.count("*").alias("a"))
    own = true.join(tally(ballots, layout).withColumnRenamed("votes", "b"), ["contest", "choice"], "full_outer")
    x, y = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return own.select("contest", "choice", x.alias("long_votes"), y.alias("ballot_votes"), (y - x).alias("difference"))


def choice_counts(ballots: DataFrame, layout: Layout) -> DataFrame:
    """contest, choice, n that balancing goes by; choices without a name are named by their column."""
    own = long_cells(ballots, layout, blank_names=False).withColumn("n", C.balance_count(F.col("cell"))).where(C.is_present(F.col("cell")) & (C.strip(F.col("cell")) != "0"))
    return own.groupBy("contest", "choice").agg(F.sum("n").alias("n"))


def contest_presence(ballots: DataFrame, layout: Layout) -> DataFrame:
    """contest, ballots, with_vote: ballots that have the contest, and those with a cell that is neither blank nor 0."""
    each = []
    for contest, own in layout.sorted_contests:
        cells = F.transform(F.lit(own), lambda i: C.strip(F.get("cells", i)))
        each.append(F.struct(F.lit(contest).alias("contest"), F.exists(cells, lambda c: c != "").alias("present"), F.exists(cells, lambda c: (c != "") & (c != "0")).alias("voted")))
    rows = ballots.select(F.inline(F.array(*each))).where("present")
    return rows.groupBy("contest").agg(F.count("*").alias("ballots"), F.count_if("voted").alias("with_vote"))


def contest_needs(ballots: DataFrame, layout: Layout, min_ballots: int) -> DataFrame:
    """contest, need: ballots that contests of the group lack."""
    return contest_presence(ballots, layout).where(F.col("ballots") < min_ballots).select("contest", (min_ballots - F.col("ballots")).alias("need"))


def undervotes(ballots: DataFrame, layout: Layout) -> DataFrame:
    """contest, eligible, with_vote, undervotes."""
    return contest_presence(ballots, layout).select("contest", F.col("ballots").alias("eligible"), "with_vote", F.greatest(F.col("ballots") - F.col("with_vote"), F.lit(0)).alias("undervotes"))


def summary_totals(ballots: DataFrame, layout: Layout) -> DataFrame:
    """contest, choice, votes: cells that are exactly 1."""
    return long_cells(ballots, layout).where(C.strip(F.col("cell")) == "1").groupBy("contest", "choice").agg(F.count("*").alias("votes"))


def summary_probabilities(styled: DataFrame, layout: Layout, names: DataFrame) -> DataFrame:
    """name, pattern, ballot_count, contest, choice, probability. Votes are pooled by the choice's name over contests,
    as the published summary does, so that a probability may exceed 1."""
    own = long_cells(styled, layout, "pattern", "ord")
    ballots = styled.groupBy("pattern").agg(F.count("*").alias("ballot_count"))
    votes = own.where(C.strip(F.col("cell")) == "1").groupBy("pattern", "choice").agg(F.count("*").alias("votes"))
    contests = F.explode(C.contests_on(F.col("cells"), layout)).alias("contest")
    eligible = styled.select("pattern", contests).groupBy("pattern", "contest").agg(F.count("*").alias("eligible"))
    columns = layout.frame(styled.sparkSession).select("contest", "choice").distinct()
    rows = eligible.join(F.broadcast(columns), "contest").join(votes, ["pattern", "choice"], "left").join(ballots, "pattern").join(names.select("pattern", "name"), "pattern")
    return rows.select("name", "pattern", "ballot_count", "contest", "choice", (F.coalesce("votes", F.lit(0)) / F.col("eligible")).alias("probability"))
