"""Contest-level redaction: a table of votes by style and choice for each contest, with totals by style and by choice, that
hides small cells so that the totals do not give them back.

Primary: a cell of fewer than k votes, but more than none, is hidden. Complementary: each such cell (r, c) becomes part of
a pattern of hidden values that can be shifted against each other by k votes in all, with every published value as it is:

- a donor choice c2 of the same style and a donor style r2 of the same choice, both with k votes or more: the cells (r, c),
  (r, c2), (r2, c), (r2, c2) form a loop, along which votes move with all totals unchanged;
- no donor choice: (r, c) and (r2, c), and the totals of both styles;
- no donor style: (r, c) and (r, c2), and the totals of both choices;
- neither: the whole contest with its totals.

Donors are the smallest cells that will do, one for each style and one for each choice of a contest: two aggregates and
joins on keys. Hiding more widens the bounds of what is hidden, so that patterns need not know of each other. `width` is the
least range that a hidden cell is known to have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollveil.functions import cells as C
from pollveil.operators import tally as T
from pollveil.plans.model import Layout
from pollveil.plans.store import cut


def style_table(styled: DataFrame, layout: Layout, by: str = "pattern") -> DataFrame:
    """contest, style, choice, votes: ballots with a cell that is exactly 1. Every style that has a contest has a row for each
    of its choices."""
    votes = T.long_cells(styled, layout, by).where(C.strip(F.col("cell")) == "1").groupBy("contest", by, "choice").agg(F.count("*").alias("votes"))
    has = styled.select(by, F.explode(C.contests_on(F.col("cells"), layout)).alias("contest")).distinct()
    columns = layout.frame(styled.sparkSession).select("contest", "choice").distinct()  # as wide as a ballot
    grid = has.join(F.broadcast(columns), "contest").join(votes, ["contest", by, "choice"], "left")
    return grid.select("contest", F.col(by).alias("style"), "choice", F.coalesce("votes", F.lit(0)).alias("votes"))


def suppress(table: DataFrame, k: int) -> DataFrame:
    """kind (cell, style or choice: a total), contest, style, choice, votes (null where hidden), reason (primary,
    complementary, contest; null where shown), width (of hidden cells; null for a whole contest, which nothing bounds): a row for each cell of
    table (contest, style, choice, votes; each cell once) and for each total. An empty table gives no rows."""
    table = cut(table.select("contest", "style", "choice", "votes"))
    enough = F.col("votes") >= k
    of_style = table.where(enough).groupBy("contest", "style").agg(F.min(F.struct(F.col("votes"), F.col("choice"))).alias("s"))
    of_choice = table.where(enough).groupBy("contest", "choice").agg(F.min(F.struct(F.col("votes"), F.col("style"))).alias("c"))
    small = table.where((F.col("votes") > 0) & ~enough).join(of_style, ["contest", "style"], "left").join(of_choice, ["contest", "choice"], "left")
    corner = table.select("contest", F.col("style").alias("r2"), F.col("choice").alias("c2"), F.col("votes").alias("corner"))
    small = small.select("contest", "style", "choice", "votes", F.col("s.choice").alias("c2"), F.col("s.votes").alias("n2"), F.col("c.style").alias("r2"), F.col("c.votes").alias("m2")).join(corner, ["contest", "r2", "c2"], "left")
    loop = F.col("c2").isNotNull() & F.col("r2").isNotNull()
    # Votes that can move into the cell, and out of it.
    width = F.when(loop, F.least("n2", "m2") + F.least("votes", F.coalesce("corner", F.lit(0)))).otherwise(F.coalesce("n2", "m2") + F.col("votes"))
    small = cut(small.withColumn("width", width))
    cell = lambda style, choice, reason: F.struct(F.col(style).alias("style"), F.col(choice).alias("choice"), F.lit(reason).alias("reason"))
    none = F.lit(None)
    each = F.array(
        cell("style", "choice", "primary"),
        F.when(F.col("c2").isNotNull(), cell("style", "c2", "complementary")),
        F.when(F.col("r2").isNotNull(), cell("r2", "choice", "complementary")),
        F.when(loop, cell("r2", "c2", "complementary")),
    )
    hidden = small.where("c2 is not null or r2 is not null").select("contest", "width", F.inline(F.array_compact(each)))
    hidden = hidden.groupBy("contest", "style", "choice").agg(F.max("reason").alias("reason"), F.max("width").alias("width"))  # primary is the last by name
    whole = small.where("c2 is null and r2 is null").select("contest").distinct().withColumn("whole", F.lit(True))
    styles = small.where("c2 is null and r2 is not null").select("contest", F.explode(F.array("style", "r2")).alias("style")).distinct().withColumn("gone", F.lit(True))
    choices = small.where("r2 is null and c2 is not null").select("contest", F.explode(F.array("choice", "c2")).alias("choice")).distinct().withColumn("gone", F.lit(True))
    cells = table.join(hidden, ["contest", "style", "choice"], "left").select(F.lit("cell").alias("kind"), "contest", "style", "choice", "votes", "reason", "width")
    text = none.cast("string")
    sums = [
        table.groupBy("contest", "style").agg(F.sum("votes").alias("votes")).join(styles, ["contest", "style"], "left").select(F.lit("style").alias("kind"), "contest", "style", text.alias("choice"), "votes", F.when(F.col("gone"), "complementary").alias("reason"), none.cast("long").alias("width")),
        table.groupBy("contest", "choice").agg(F.sum("votes").alias("votes")).join(choices, ["contest", "choice"], "left").select(F.lit("choice").alias("kind"), "contest", text.alias("style"), "choice", "votes", F.when(F.col("gone"), "complementary").alias("reason"), none.cast("long").alias("width")),
    ]
    rows = cells.unionByName(sums[0]).unionByName(sums[1]).join(whole, "contest", "left")
    reason = F.when(F.col("whole"), "contest").otherwise(F.col("reason"))
    return rows.select("kind", "contest", "style", "choice", F.when(reason.isNull(), F.col("votes")).alias("votes"), reason.alias("reason"), F.when(F.col("whole").isNull() & (F.col("kind") == "cell"), F.col("width")).alias("width"))
