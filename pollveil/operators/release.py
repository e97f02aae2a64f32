"""The release: rare ballots and their company become one aggregate row; all others go out redacted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollveil.functions import cells as C
from pollveil.operators import balance as B
from pollveil.operators import entropy as E
from pollveil.operators import styles as S
from pollveil.operators import tally as T
from pollveil.plans.model import AGGREGATE_PREFIX, HEADER, Config, CvrError, Layout
from pollveil.plans.store import cut


def redact(ballots: DataFrame) -> DataFrame:
    """Blank counting group and precinct portion."""
    return ballots.withColumns({"counting_group": F.lit(""), "style": F.lit("")})


def without_aggregated(ballots: DataFrame, aggregated: DataFrame) -> DataFrame:
    """Ballots whose trimmed CVR number is not among the aggregated ones; blank numbers and those of aggregates are never
    dropped."""
    numbers = aggregated.select(C.strip(F.col("cvr_number")).alias("__number")).where((F.col("__number") != "") & ~F.col("__number").startswith(AGGREGATE_PREFIX)).distinct()
    return ballots.join(numbers, C.strip(F.col("cvr_number")) == F.col("__number"), "left_anti")


def aggregate_row(group: DataFrame, identifier: str = AGGREGATE_PREFIX + "1") -> DataFrame:
    """One row in a ballot's columns: header blanked, each vote column added up over the group (0 where nothing is)."""
    sums = T.column_sums(group).select("col_idx", T.printed(F.col("total")).alias("cell"))
    row = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "cell"))), lambda x: x.cell).alias("cells"))  # as wide as a ballot
    return row.select(F.lit(None).cast("long").alias("ord"), *(v.alias(c) for c, v in C.blanked_header(identifier).items()), "cells", (F.size("cells") + len(HEADER)).alias("n_fields"))


def in_output_order(rows: DataFrame) -> DataFrame:
    """Numbers, other names, aggregates; equal keys in file order. A global sort by ranges."""
    keys = C.sort_key(F.col("cvr_number"))
    return rows.withColumns(keys).orderBy("sort_class", F.col("sort_number").asc_nulls_last(), "sort_digits", "sort_text", F.col("ord").asc_nulls_last()).drop(*keys)


@dataclass
class Release:
    ballots: DataFrame
    aggregate: DataFrame | None
    membership: DataFrame  # ord, bucket
    stats: dict = field(default_factory=dict)
    rare_styles: DataFrame | None = None  # sig, descriptive_name, ballot_count, original_styles (style, n): a row for each
    styles: DataFrame | None = None  # style, n: a row for each CVR style

    @property
    def output(self) -> DataFrame:
        rows = self.ballots if self.aggregate is None else self.ballots.unionByName(self.aggregate)
        return in_output_order(rows)

    def all_stats(self) -> dict:
        """stats, with style_counts (ballots of each CVR style) and rare_style_counts (name, ballots and CVR styles of each
        rare style) collected: for reports on as many styles as a driver should hold."""
        rare = [{"descriptive_name": r.descriptive_name, "ballot_count": r.ballot_count, "original_styles": [(s.style, s.n) for s in r.original_styles]} for r in self.rare_styles.orderBy("descriptive_name", "sig").collect()]
        return self.stats | {"style_counts": {r["style"]: r["n"] for r in self.styles.orderBy("style").collect()}, "rare_style_counts": rare}


def check_input(ballots: DataFrame, config: Config) -> int:
    """How many rows there are. spec only: cells that tallies cannot count, and CVR numbers that name more than one ballot,
    are refused before anything is written. One job."""
    if config.mode != "spec":
        return ballots.count()
    odd = F.when(F.exists("cells", lambda c: ~C.strip(c).isin("", "0", "1")), F.coalesce("cvr_number", F.lit("")))
    by_number = ballots.groupBy(C.strip(F.col("cvr_number")).alias("number")).agg(F.count("*").alias("n"), F.min(odd).alias("odd"))
    found = by_number.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("odd").alias("odd"), F.min(F.when((F.col("n") > 1) | (F.col("number") == ""), F.col("number"))).alias("twice")).first()
    if found.odd is not None:
        raise CvrError(f"ballot {found.odd}: a vote cell is neither blank nor 0 nor 1")
    if found.twice is not None:
        raise CvrError(f"CVR number {found.twice!r} is blank or not unique")
    return found.rows


def anonymize(ballots: DataFrame, layout: Layout, config: Config | None = None) -> Release:
    """The whole release. Raises CvrError where no aggregate of the minimum size can be made, and where tallies of the
    input and of the output differ; the caller writes only what passed.

    stats has driver-side numbers alone; final_styles counts the common styles left and the aggregate."""
    config = config or Config()
    k, mode = config.min_ballots, config.mode
    total_rows = check_input(ballots, config)
    styled = cut(S.with_style(ballots, layout))
    groups = S.rare_common(styled, k)
    sizes = groups.agg(F.count("*").alias("styles"), F.coalesce(F.sum(F.when(F.col("is_rare"), F.col("n"))), F.lit(0)).alias("rare"), F.count_if(~F.col("is_rare")).alias("common"), B.largest().alias("largest")).first()
    stats = {"total_rows": total_rows, "original_styles": sizes.styles, "rare_ballots_initial": sizes.rare, "min_ballots": k, "ballots_borrowed_for_minimum": 0, "contests_needing_ballots": {}, "ballots_added_for_contests": 0, "contests_needing_balancing": [], "ballots_added_for_balancing": 0, "aggregated_rows": 0, "final_styles": sizes.common}
    spark = ballots.sparkSession
    if not sizes.rare:
        return Release(redact(ballots), None, styled.select("ord", F.lit("released").alias("bucket")), stats | {"rare_styles": 0}, S.rare_counts(styled, k), S.cvr_style_counts(ballots))

    rare = S.with_rarity(styled, k).where("is_rare").select(styled.columns)
    borrowed = B.borrow(styled, k, sizes.rare, sizes.largest)
    members = cut(rare.select("*", F.lit("rare").alias("bucket")).unionByName(borrowed.select("*", F.lit("borrowed").alias("bucket"))))
    stats["rare_styles"] = sizes.rare  # ballots, as the historical report has it
    stats["totals_after_rare_styles"] = _nested(T.group_tally(rare, layout, mode))
    stats["ballots_borrowed_for_minimum"] = members.where("bucket = 'borrowed'").count()
    pool = B.pool_after(styled, members.where("bucket = 'borrowed'"), k)  # stored once something is picked from it
    present = T.contest_presence(members, layout).collect()  # a row for each contest at most
    stats["contest_ballot_counts_after_rare"] = {r.contest: r.ballots for r in present}
    stats["contest_ballot_vote_counts_after_rare"] = {r.contest: r.with_vote for r in present}
    stats["contest_ballot_counts"] = stats["contest_ballot_counts_after_rare"]
    needs = {r.contest: k - r.ballots for r in present if r.ballots < k}
    stats["contests_needing_ballots"] = dict(sorted(needs.items()))
    if needs:
        pool = cut(pool)
    covering = B.cover_contests(pool, layout, needs, B.as_counts(T.choice_counts(members, layout)), k)
    stats["ballots_added_for_contests"] = len(covering)

    def add(places: list[int], bucket: str) -> None:
        nonlocal members, pool
        if places:
            chosen = spark.createDataFrame([(p,) for p in places], "ord long")  # the picks alone
            members = cut(members.unionByName(pool.join(F.broadcast(chosen), "ord").select(*styled.columns, F.lit(bucket).alias("bucket"))))
            rest = pool.join(F.broadcast(chosen), "ord", "left_anti").drop("n")
            pool = cut(rest.join(rest.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= k), "sig"))

    add(covering, "coverage")
    flagged = {r.contest: r.winner for r in T.near_unanimous(T.group_tally(members, layout, mode)).collect()}
    winners = {c: flagged[c] for c in layout.contests if c in flagged}
    stats["contests_needing_balancing"] = list(winners.items())
    if winners and not needs:
        pool = cut(pool)
    contrast = B.pick_contrast(B.contrast_scores(pool, layout, winners, k), winners, k, mode) if winners else []
    stats["ballots_added_for_balancing"] = len(contrast)
    add(contrast, "contrast")
    if config.entropy:
        lacking = {(r.contest, r.choice): r.missing for r in E.requirements(ballots, members, layout).where("missing > 0").collect()}  # as wide as a ballot
        varied, unmet = E.pick(pool, layout, lacking, k)
        stats |= {"ballots_added_for_entropy": len(varied), "entropy_unmet": dict(sorted(unmet.items()))}
        add(varied, "entropy")

    aggregate = cut(aggregate_row(members))
    released = redact(without_aggregated(ballots, members))
    stats["aggregated_rows"] = 1
    present = T.contest_presence(members, layout).collect()
    stats["final_contest_ballot_counts"] = {r.contest: r.ballots for r in present}
    stats["final_contest_vote_counts"] = {r.contest: r.with_vote for r in present}
    stats["final_aggregate_totals"] = _nested(T.tally(aggregate, layout))
    unchanged = not (stats["ballots_borrowed_for_minimum"] or covering or contrast or stats.get("ballots_added_for_entropy"))
    stats["final_styles"] = (sizes.common if unchanged else pool.select("sig").distinct().count()) + 1
    wrong = T.verify(ballots, released.unionByName(aggregate), layout).where("difference <> 0").limit(5).collect()
    if wrong:
        raise CvrError(f"tallies differ: {[tuple(r) for r in wrong]}")
    if mode == "spec":
        check_release(released, aggregate, members, layout, k)
    membership = members.select("ord", "bucket").unionByName(styled.join(members.select("ord"), "ord", "left_anti").select("ord", F.lit("released").alias("bucket")))
    return Release(released, aggregate, membership, stats, S.rare_counts(styled, k), S.cvr_style_counts(ballots))


def _nested(totals: DataFrame) -> dict[str, dict[str, int]]:
    """contest -> choice -> votes; as many as a ballot has choices."""
    out: dict[str, dict[str, int]] = {}
    for r in totals.orderBy("contest", "choice").collect():
        out.setdefault(r.contest, {})[r.choice] = r.votes
    return out


def check_release(released: DataFrame, aggregate: DataFrame, members: DataFrame, layout: Layout, k: int) -> None:
    """No style goes out with fewer than k ballots, and the aggregate stands for k at least."""
    small = S.style_groups(S.with_style(released, layout)).where(F.col("n") < k).limit(1).collect()
    if small or members.count() < k:
        raise CvrError(f"a released style or the aggregate has fewer than {k} ballots")
