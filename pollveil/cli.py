"""Command line: anonymize a CVR file, or write sheets of vote probabilities."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.functions import cells as C
from pollveil.operators import inference as I
from pollveil.operators import release as R
from pollveil.operators import styles as S
from pollveil.operators import tally as T
from pollveil.plans.model import Config, Layout
from pollveil.sources import cvrfile, scan, sink
from pollveil.sources.synthetic import LAYOUT, synthetic_case

# The sheets' file names.
SHEETS = ["test_case_results_probabilities.csv", "test_case_original_probabilities.csv", "test_case_anonymized_probabilities.csv"]


def _table(title: str, columns: tuple[str, ...], rows: Iterable[tuple]) -> None:
    """A titled table, if it has rows."""
    for i, row in enumerate(rows):
        if i == 0:
            print(f"# {title}", *columns, sep="\t")
        print(*row, sep="\t")


def _frame(title: str, found: DataFrame, *order: str) -> None:
    _table(title, tuple(found.columns), found.orderBy(*order).toLocalIterator())


def show_styles(styled: DataFrame, layout: Layout, analysis: S.StyleAnalysis, summarize: bool) -> None:
    """Each CVR style with its ballots and descriptive name; with `summarize` the votes by contest, and for each descriptive
    style how many ballots it has and what share of them each choice got."""
    mapping = analysis.cvr_styles.groupBy(C.strip(F.col("style")).alias("style")).agg(F.min("name").alias("name"))
    _frame("CVR styles", analysis.sizes.join(mapping, "style").select("style", F.col("n").alias("ballots"), "name"), "style")
    if summarize:
        _frame("Votes", T.summary_totals(styled, layout), "contest", "choice")
        shares = T.summary_probabilities(styled, layout, analysis.patterns)
        _frame("Style statistics", shares.select("name", "pattern", F.col("ballot_count").alias("ballots"), "contest", "choice", F.format_number("probability", 4).alias("share")), "name", "contest", "choice")


def anonymize(spark: SparkSession, source: str, target: str, config: Config, summarize: bool = False, parts: bool = False, range_bytes: int | None = None) -> R.Release:
    """Reads, releases, verifies, and only then writes: one local file, or with `parts` a folder that executors write. A
    target that ends in .parquet gets Parquet. range_bytes: CSV is read by byte ranges of that size."""
    file = scan.scan_csv(spark, source, config, range_bytes) if range_bytes else cvrfile.read(spark, source, config)
    analysis = S.analyze(file.ballots, file.layout, config.min_ballots)
    show_styles(S.with_style(file.ballots, file.layout), file.layout, analysis, summarize)
    for title, found in (("several CVR styles", analysis.shared_patterns), ("several ballot types", analysis.shared_ballot_types)):
        for r in found.orderBy("pattern").collect():
            print(f"Warning: pattern {r.pattern[:60]} has {title}: {r[1][:60]}", file=sys.stderr)
    release = R.anonymize(file.ballots, file.layout, config)
    if cvrfile.is_parquet(target):
        release.output.write.parquet(target)
    elif parts:
        sink.write_release(release.output, file.preamble, target, file.terminator)
    else:
        cvrfile.write_csv(release.output, file.preamble, target, file.terminator)
    report(release, target)
    return release


def statistics(release: R.Release) -> list[tuple[str, object]]:
    """(name, value) of what a release did as a whole."""
    s = release.stats
    added = [s["ballots_borrowed_for_minimum"], s["ballots_added_for_contests"], s["ballots_added_for_balancing"], s.get("ballots_added_for_entropy", 0)]
    return [
        ("rows read", s["total_rows"]), ("styles before", s["original_styles"]), ("styles after", s["final_styles"]), ("minimum", s["min_ballots"]),
        ("ballots of rare styles", s["rare_ballots_initial"]), ("added for the minimum", added[0]), ("added for contests", added[1]), ("added against unanimity", added[2]), ("added for the entropy rule", added[3]),
        ("ballots in the aggregate", s["rare_ballots_initial"] + sum(added)), ("aggregate rows", s["aggregated_rows"]),
    ]


def contest_table(release: R.Release) -> list[tuple]:
    """A row for each contest of the aggregate: contest; ballots with it and with a vote, of rare styles and at last; how many
    it lacked; the choice that nearly all had; votes by choice, of rare styles and at last."""
    s = release.stats
    before, after = s.get("contest_ballot_counts_after_rare", {}), s.get("final_contest_ballot_counts", {})
    voted, voted_after = s.get("contest_ballot_vote_counts_after_rare", {}), s.get("final_contest_vote_counts", {})
    totals, totals_after = s.get("totals_after_rare_styles", {}), s.get("final_aggregate_totals", {})
    votes = lambda of: " ".join(f"{choice}={n}" for choice, n in sorted(of.items()) if n)
    lead = dict(s["contests_needing_balancing"])
    return [(c, before.get(c, 0), voted.get(c, 0), after.get(c, 0), voted_after.get(c, 0), s["contests_needing_ballots"].get(c, 0), lead.get(c, ""), votes(totals.get(c, {})), votes(totals_after.get(c, {}))) for c in sorted(before | after | totals | totals_after)]


def report(release: R.Release, target: str) -> None:
    """Tables on standard output, with tabs between columns: statistics, rare styles, contests."""
    _table(f"Released to {target}", ("name", "value"), statistics(release))
    styles = ((r.descriptive_name, r.ballot_count, " ".join(f"{s.style}:{s.n}" for s in r.original_styles)) for r in release.rare_styles.orderBy("descriptive_name", "sig").toLocalIterator())
    _table("Rare styles", ("name", "ballots", "CVR styles"), styles)
    _table("Contests of the aggregate", ("contest", "rare_ballots", "rare_voted", "ballots", "voted", "lacking", "nearly_unanimous_for", "rare_votes", "votes"), contest_table(release))


def guess(spark: SparkSession, source: str | None, anonymized: str | None, min_ballots: int, folder: str = ".", election: str = "Test Election 2024", parts: bool = False) -> list[str]:
    """Three sheets: overall, by the original's styles, through the anonymized file. Without a source the test election
    is written first. parts: each sheet is a folder that executors write, in place of one local file."""
    if source is None:
        source = os.path.join(folder, "test_case_cvr.csv")
        cvrfile.write_csv(synthetic_case(spark), cvrfile.preamble_of(LAYOUT, election), source)
    file = cvrfile.read(spark, source)
    own = I.in_style_order(file.ballots.where("n_fields > 6")).drop("ord").withColumnRenamed("voter", "ord")
    overall = I.overall_probabilities(own, file.layout)
    by_style = I.style_probabilities(own, file.layout, min_ballots)
    sheets = [I.ballot_probabilities(own, file.layout, overall), I.ballot_probabilities(own, file.layout, overall, by_style)]
    if anonymized:
        other = cvrfile.read(spark, anonymized)
        rows = I.marked_style(other.ballots)
        aggregate = F.col("style").startswith("AGGREGATED-")
        columns = ["style", "contest", "choice", "prob"]
        through = I.style_probabilities(rows.where(~aggregate), other.layout, min_ballots).select(columns).unionByName(I.aggregate_probabilities(rows.where(aggregate), other.layout, min_ballots).select(columns))
        sheets.append(I.ballot_probabilities(own, file.layout, overall, through, I.style_mapping(own, rows)))
    else:
        sheets.append(sheets[0])
    paths = [os.path.join(folder, n) for n in SHEETS]
    for sheet, path in zip(sheets, paths, strict=True):
        (sink.write_sheet_parts if parts else cvrfile.write_sheet)(I.wide_sheet(sheet, file.layout), path)
    return paths


def first_line(e: Exception) -> str:
    """What an error says, without the stacks that Spark adds."""
    text = str(e.java_exception) if isinstance(e, Py4JJavaError) else str(e)
    return next((x.strip() for x in text.splitlines() if x.strip()), type(e).__name__)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pollveil", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("anonymize")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--min-ballots", type=int, default=10)
    a.add_argument("--stylecol", type=int, default=6)
    a.add_argument("--headerlen", type=int, default=8)
    a.add_argument("--summarize", "-s", action="store_true")
    a.add_argument("--parts", action="store_true", help="write a folder of parts by executors in place of one file")
    a.add_argument("--range-mb", type=int, help="read CSV by byte ranges of so many megabytes")
    a.add_argument("--entropy", action="store_true", help="the aggregate holds votes for each choice with a good share")
    a.add_argument("--mode", choices=["spec", "compat"], default="spec")
    g = commands.add_parser("guess")
    g.add_argument("original", nargs="?")
    g.add_argument("--anonymized-cvr", "-a")
    g.add_argument("--election-name", "-n", default="Test Election 2024")
    g.add_argument("--min-ballots", "-m", type=int, default=10)
    g.add_argument("--parts", action="store_true", help="write each sheet as a folder of parts by executors in place of one file")
    for command in (a, g):
        command.add_argument("--checkpoint-dir", help="a folder that all executors share; needed on a cluster")
    own = parser.parse_args(args)
    spark = SparkSession.builder.appName("pollveil").getOrCreate()
    if own.checkpoint_dir:
        spark.sparkContext.setCheckpointDir(own.checkpoint_dir)
    try:
        if own.command == "anonymize":
            anonymize(spark, own.input, own.output, Config(own.min_ballots, own.stylecol, own.headerlen, own.mode, own.entropy), own.summarize, own.parts, own.range_mb * (1 << 20) if own.range_mb else None)
        else:
            print("\n".join(guess(spark, own.original, own.anonymized_cvr, own.min_ballots, election=own.election_name, parts=own.parts)))
    except Exception as e:  # whatever fails, also in Spark: its first line, and exit code 1
        print(f"Error: {first_line(e)}", file=sys.stderr)
        return 1
    return 0
