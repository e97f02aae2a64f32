"""The entropy rule: of every choice that got a good share of a contest's votes, the aggregate holds some votes, so that who
knows to be in it cannot tell how all the others voted.

What the aggregate lacks are many constraints at once, which one ballot may help with in several contests. Ballots are
picked from common styles one by one, each time one that helps with most of what is still lacking; what a ballot helps with
can only become less, so that counts of its votes for lacking choices are bounds that hold, and the ranking of ballots
stays in Spark (balance.Ranking). A style gives while it is above the minimum; what cannot be met is reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollveil.functions import cells as C
from pollveil.operators import balance as B
from pollveil.operators import tally as T
from pollveil.plans.model import Layout

#: Share of a contest's votes from which on a choice counts, and votes for it that the aggregate has to hold.
SHARE, VOTES = 0.2, 3


def _votes(ballots: DataFrame, layout: Layout) -> DataFrame:
    own = T.long_cells(ballots, layout, blank_names=False)
    return own.where(C.strip(F.col("cell")) == "1").groupBy("contest", "choice").agg(F.count("*").alias("votes"))


def requirements(ballots: DataFrame, members: DataFrame, layout: Layout, share: float = SHARE, votes: int = VOTES) -> DataFrame:
    """contest, choice, total (votes of all ballots), required, held (votes of the members), missing: a row for each choice
    with the share, in contests that are on a member's ballot. No more is required than there is."""
    every = _votes(ballots, layout)
    sums = every.groupBy("contest").agg(F.sum("votes").alias("all"))
    on = T.contest_presence(members, layout).select("contest")
    own = every.join(sums, "contest").where(F.col("votes") >= share * F.col("all")).join(on, "contest", "left_semi")
    own = own.join(_votes(members, layout).withColumnRenamed("votes", "held"), ["contest", "choice"], "left")
    required, held = F.least(F.lit(votes).cast("long"), F.col("votes")), F.coalesce("held", F.lit(0))
    return own.select("contest", "choice", F.col("votes").alias("total"), required.alias("required"), held.alias("held"), F.greatest(required - held, F.lit(0)).alias("missing"))


class _Votes(B.Ranking):
    """Ballots by the lacking choices that they vote for."""

    def __init__(self, pool: DataFrame, layout: Layout, missing: dict[int, int], min_ballots: int, head: int):
        votes = F.exists(F.lit(list(missing)), lambda i: C.strip(F.get("cells", i)) == "1")
        super().__init__(pool.where((F.col("n") > min_ballots) & votes), layout, sum(missing.values()), min_ballots, head)

    def restart(self, columns: list[int]) -> None:
        profile = F.transform(F.lit(columns), lambda i: F.when(C.strip(F.get("cells", i)) == "1", "1").otherwise(""))
        self.rank(columns, profile, F.size(F.filter("profile", lambda c: c == "1")).cast("double"), 1.0)


def pick(pool: DataFrame, layout: Layout, lacking: dict[tuple[str, str], int], min_ballots: int, head: int = B.HEAD) -> tuple[list[int], dict[tuple[str, str], int]]:
    """Places of ballots in the order of their choice, and what is still missing of each (contest, choice). Equals go by
    style and place. A choice that several columns name counts in all of them."""
    columns = {i: (c, layout.choice_name(i)) for c, own in layout.contests.items() for i in own}
    missing = {key: n for key, n in lacking.items() if n > 0}
    picked: list[int] = []
    if not missing:
        return picked, {}
    of = {i: missing[key] for i, key in columns.items() if key in missing}
    ranking, ranked_for = _Votes(pool, layout, of, min_ballots, head), None
    while missing:
        if ranked_for != set(missing):
            ranked_for = set(missing)
            ranking.restart([i for i, key in columns.items() if key in missing])
        helps = lambda profile: {columns[i] for i, cell in zip(ranking.columns, profile, strict=True) if cell}  # noqa: B023, E731
        best = ranking.best(lambda profile: float(len(helps(profile))))  # noqa: B023
        if best is None:
            break
        place, _ = ranking.take(best)
        picked.append(place)
        for key in helps(best.cells):
            missing[key] -= 1
            if not missing[key]:
                del missing[key]
    return picked, missing
