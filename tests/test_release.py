from __future__ import annotations

import csv
import os

import pytest
from pyspark.sql import functions as F

from pollveil import cli
from pollveil.functions import cells as C
from pollveil.operators import balance as B
from pollveil.operators import inference as I
from pollveil.operators import release as R
from pollveil.operators import styles as S
from pollveil.operators import tally as T
from pollveil.plans.model import BALLOT_SCHEMA, Config, CvrError, Layout
from pollveil.sources import cvrfile, longform
from pollveil.sources.synthetic import LAYOUT, synthetic_case


def make(spark, rows, layout_width):
    """Ballots from (number, style, cells)."""
    return spark.createDataFrame([(i, n, "1", "1", n, n, "cg", s, "", list(c), 8 + len(c)) for i, (n, s, c) in enumerate(rows, 1)], BALLOT_SCHEMA)


TWO = Layout.of([("X", "A"), ("X", "B"), ("Y", "A"), ("Y", "B")])


def read_rows(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("case")
    paths = cli.guess(spark, None, None, 10, str(folder))
    return folder, paths


def test_synthetic_file_and_sheets(case):
    folder, paths = case
    rows = read_rows(folder / "test_case_cvr.csv")
    assert len(rows) == 25 and rows[4] == ["1", "1", "1", "1", "1-1-1", "cg", "1R1", "", "1", "0", "", ""]
    overall, styles, _ = (read_rows(p) for p in paths)
    assert overall[0] == ["Voter", "Style", "A0", "A1", "B0", "B1"]
    assert overall[2] == ["V2", "2S2", "0.6364", "0.3636", "0.5500", "0.4500"]
    assert styles[1] == ["V1", "1R1", "1.000", "0.0000", "", ""]
    assert styles[2] == ["V2", "2S2", "0.6000", "0.4000", "0.5000", "0.5000"]
    assert styles[12] == ["V12", "1S3", "", "", "0.6000", "0.4000"]


@pytest.mark.parametrize("mode", ["spec", "compat"])
def test_release_of_the_test_election(spark, case, mode):
    folder, _ = case
    out = str(folder / f"out_{mode}.csv")
    release = cli.anonymize(spark, str(folder / "test_case_cvr.csv"), out, Config(mode=mode))
    rows = read_rows(out)
    assert rows[:4] == read_rows(folder / "test_case_cvr.csv")[:4]
    assert rows[4] == ["12", "1", "1", "12", "1-1-12", "", "", "", "", "", "1", "0"]
    assert rows[-1] == ["AGGREGATED-1", "", "", "", "", "", "", "AGGREGATED", "7", "4", "5", "5"]
    assert len(rows) == 4 + 10 + 1
    stats = release.stats
    assert stats["ballots_borrowed_for_minimum"] == 10 and stats["final_styles"] == 2 and stats["rare_ballots_initial"] == 1
    assert stats["totals_after_rare_styles"] == {"A": {"A0": 1}}
    assert stats["final_aggregate_totals"] == {"A": {"A0": 7, "A1": 4}, "B": {"B0": 5, "B1": 5}}
    assert stats["final_contest_ballot_counts"] == {"A": 11, "B": 10}


def test_sheet_through_a_legacy_release(spark, case):
    folder, _ = case
    rows = read_rows(folder / "test_case_cvr.csv")
    legacy = rows[:4] + [r[:6] + ["1S3"] + r[7:] for r in rows[15:]] + [["", "", "", "", "", "", "AGGREGATED-1", "", "7", "4", "5", "5"]]
    path = str(folder / "legacy.csv")
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows(legacy)
    sheet = read_rows(cli.guess(spark, str(folder / "test_case_cvr.csv"), path, 10, str(folder))[2])
    assert sheet[1] == ["V1", "AGGREGATED-1", "0.6364", "0.3636", "", ""]
    assert sheet[2] == ["V2", "AGGREGATED-1", "0.6364", "0.3636", "0.5000", "0.5000"]
    assert sheet[12] == ["V12", "1S3", "", "", "0.6000", "0.4000"]


def test_nothing_rare(spark):
    b = make(spark, [(str(i), "s", "1000") for i in range(12)], 4)
    b = b.withColumn("cells", F.array(F.lit("1"), F.lit("0"), F.lit(""), F.lit("")))
    out = R.anonymize(b, TWO)
    assert out.aggregate is None and out.output.count() == 12
    assert out.output.select("counting_group", "style").distinct().collect() == [("", "")]


def test_no_style_to_borrow_from(spark):
    b = make(spark, [("1", "s", ["1", "0", "", ""]), ("2", "s", ["", "", "1", "0"])], 4)
    with pytest.raises(CvrError, match="no common style"):
        R.anonymize(b, TWO)


def test_empty_table(spark):
    b = make(spark, [("1", "s", ["1", "0", "", ""])], 4).where("false")
    out = R.anonymize(b, TWO)
    assert out.aggregate is None and out.output.count() == 0


def test_refuses_odd_cells_and_repeated_numbers(spark):
    with pytest.raises(CvrError, match="neither blank"):
        R.anonymize(make(spark, [("1", "s", ["2", "0", "", ""])], 4), TWO)
    with pytest.raises(CvrError, match="not unique"):
        R.anonymize(make(spark, [("1", "s", ["1", "0", "", ""]), (" 1", "s", ["1", "0", "", ""])], 4), TWO)


def test_borrows_only_what_is_missing(spark):
    rows = [("r", "s", ["1", "0", "1", "0"])] + [(f"{i}", "s", ["0", "1", "", ""]) for i in range(30)]
    styled = S.with_style(make(spark, rows, 4), TWO)
    assert [r.cvr_number for r in B.borrow_for_minimum(styled, 5).orderBy("ord").collect()] == ["0", "1", "2", "3"]


def test_unanimity_modes(spark):
    group = make(spark, [(str(i), "s", ["1", "0", "1", "0"]) for i in range(9)] + [("x", "s", ["0", "1", "1", "0"])], 4)
    spec = {r.contest: (r.winner, r.winner_votes) for r in T.near_unanimous(T.group_tally(group, TWO, "spec")).collect()}
    compat = {r.contest: (r.winner, r.winner_votes) for r in T.near_unanimous(T.group_tally(group, TWO, "compat")).collect()}
    assert spec == {"X": ("A", 9), "Y": ("A", 10)}
    assert compat == {"X": ("B", 1)}  # the sum of exactly 1 is the only one that counts


def test_contrast_never_drains_a_donor(spark):
    rare = [(f"r{i}", "s", ["1", "0", "1", "0"]) for i in range(3)]
    donors = [(f"d{i}", "s", ["0", "1", "", ""]) for i in range(4)] + [(f"e{i}", "s", ["", "", "0", "1"]) for i in range(6)]
    out = R.anonymize(make(spark, rare + donors, 4), TWO, Config(min_ballots=4))
    assert out.stats["contests_needing_balancing"]
    left = S.style_groups(S.with_style(out.ballots, TWO)).collect()
    assert all(r.n >= 4 for r in left)
    assert not T.verify(make(spark, rare + donors, 4), out.output, TWO).where("difference <> 0").count()


def cover_by_hand(pool, needs, counts, k):
    """The loop as its description reads: row at a time."""
    needs, counts, picked = dict(needs), {c: dict(x) for c, x in counts.items()}, []
    gap = lambda c: 2 * max(c.values(), default=0) - sum(c.values())
    while needs:
        sizes = {}
        for r in pool:
            sizes[r.sig] = sizes.get(r.sig, 0) + 1
        best = None
        for r in sorted(pool, key=lambda r: (r.style_ord, r.ord)):
            if sizes[r.sig] <= k:
                continue
            covered = [c for c in needs if any(r.cells[i] for i in TWO.contests[c])]
            if not covered:
                continue
            score = 10.0 * len(covered)
            for c in covered:
                new = dict(counts.get(c, {}))
                voted = [TWO.columns[i].choice for i in TWO.contests[c] if r.cells[i] == "1"]
                for v in voted:
                    new[v] = new.get(v, 0) + 1
                score += max(0, gap(counts.get(c, {})) - gap(new)) if voted else 0
            if best is None or score > best[0]:
                best = score, r, covered
        if best is None:
            return picked
        r = best[1]
        picked.append(r.ord)
        pool = [p for p in pool if p.ord != r.ord]
        for c, own in TWO.contests.items():
            for i in own:
                if r.cells[i] == "1":
                    counts.setdefault(c, {})[TWO.columns[i].choice] = counts.get(c, {}).get(TWO.columns[i].choice, 0) + 1
        for c in best[2]:
            needs[c] -= 1
            if not needs[c]:
                del needs[c]
    return picked


def test_coverage_loop_against_the_plain_one(spark):
    rows = [(f"{i}", "s", c) for i, c in enumerate([["1", "0", "", ""]] * 6 + [["0", "1", "1", "0"]] * 7 + [["0", "1", "0", "1"]] * 6 + [["", "", "0", "1"]] * 5 + [["1", "0", "0", "0"]] * 3)]
    styled = S.with_style(make(spark, rows, 4), TWO)
    pool = B.pool_after(styled, styled.where("false"), 3).cache()
    needs, counts = {"X": 4, "Y": 2}, {"X": {"A": 5, "B": 1}, "Y": {"A": 3}}
    by_hand = cover_by_hand(pool.collect(), needs, counts, 3)
    assert B.cover_contests(pool, TWO, needs, counts, 3) == by_hand
    for head in (1, 2, 3):
        assert B.cover_contests(pool, TWO, needs, counts, 3, head=head) == by_hand
    assert B.cover_contests(pool.repartition(5), TWO, needs, counts, 3) == by_hand


def test_cells(spark):
    rows = spark.createDataFrame([("1.5",), ("-3",), ("1-2",), ("1e3",), (" 1 ",), ("",), (None,), ("nan",), ("+1",), (" 1",)], "c string")
    assert [r[0] for r in rows.select(C.summand(F.col("c"))).collect()] == [1.5, -3.0, None, None, 1.0, None, None, None, None, 1.0]
    assert [r[0] for r in rows.select(C.vote_count(F.col("c"), F.lit(False))).collect()] == [0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    assert [r[0] for r in rows.limit(7).select(C.balance_count(F.col("c"))).collect()] == [1, -3, 1, 1000, 1, 0, 0]


def test_formatting(spark):
    values = [0.0, 1.0, 2.0, 0.03125, 0.00005, 1 / 3, None]
    got = spark.createDataFrame([(v,) for v in values], "p double").select(C.format_probability("p")).collect()
    assert [r[0] for r in got] == ["0.0000", "1.000", "1.000", "0.0312", "0.0001", "0.3333", ""]


def test_output_order(spark):
    b = make(spark, [(n, "s", ["1"]) for n in ["AGGREGATED-2", "b", "10", "9", "AGGREGATED-x", "AGGREGATED-1", "a", "9"]], 1)
    assert [r.cvr_number for r in R.in_output_order(b).collect()] == ["9", "9", "10", "a", "b", "AGGREGATED-1", "AGGREGATED-2", "AGGREGATED-x"]


def test_similarity(spark):
    pairs = spark.createDataFrame([("abc110", "abc011", 1 / 3), ("abc", "abc", 1.0), ("abc1", "abc", 0.0), ("", "abc000", 1.0)], "a string, b string, want double")
    assert all(abs(r.got - r.want) < 1e-12 for r in pairs.withColumn("got", C.style_similarity(F.col("a"), F.col("b"))).collect())


@pytest.mark.parametrize("end", ["\r\n", "\n", "\r"])
def test_ragged_file_and_line_ends(spark, tmp_path, end):
    lines = ["E,V1,,,,,,", ",,,,,,,,X,X,Y,Y", ",,,,,,,,A,B,A,B", ",".join(cvrfile.HEADER_NAMES) + ",A,B,A,B", '1,1,1,1,"i, 1",cg,s,,1,0,,', "2,1", "", "3,1,1,3,i3,cg,s,,0,1"]
    path = tmp_path / "in.csv"
    path.write_bytes((end.join(lines) + end).encode())
    file = cvrfile.read(spark, str(path))
    rows = file.ballots.orderBy("ord").collect()
    assert file.terminator == end and file.layout == TWO
    assert [r.n_fields for r in rows] == [12, 2, 0, 10]
    assert rows[0].imprinted == "i, 1" and rows[0].cells == ["1", "0", "", ""] and rows[3].cells == ["0", "1"] and rows[1].cells == []
    assert [r[0] for r in S.with_style(file.ballots, TWO).orderBy("ord").select("sig").collect()] == ["1100", "11"]
    out = tmp_path / "out.csv"
    cvrfile.write_csv(R.in_output_order(R.redact(file.ballots)), file.preamble, str(out), end)
    assert out.read_bytes().decode().split(end)[4:] == ['1,1,1,1,"i, 1",,,,1,0,,', "2,1", "3,1,1,3,i3,,,,0,1", ""]


def test_short_file(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("a\nb\n")
    with pytest.raises(CvrError, match="four rows"):
        cvrfile.read(spark, str(path))


def test_long_form(spark, tmp_path):
    rows = [("v2", "X", "A", True, 7.0), ("v2", "Y", "B", False, 7.0), ("v1", "X", "B", True, 3.0), ("v1", "Y", "B", True, 3.0), ("v0", "X", "A", False, 1.0)]
    long = spark.createDataFrame(rows, "voter_id string, contest string, candidate string, isVote boolean, precinctPortionId double")
    long.write.parquet(str(tmp_path / "long.parquet"))
    file = cvrfile.read(spark, str(tmp_path / "long.parquet"))
    got = file.ballots.orderBy("ord").collect()
    assert [(c.contest, c.choice) for c in file.layout.columns] == [("X", "A"), ("X", "B"), ("Y", "B")]
    assert [(r.cvr_number, r.imprinted, r.style, r.cells) for r in got] == [("1", "v1", "3", ["0", "1", "1"]), ("2", "v2", "7", ["1", "0", ""])]
    with pytest.raises(CvrError, match="isVote"):
        longform.votes(long.drop("isVote"))


LONG = "voter_id string, contest string, candidate string, isVote boolean, precinctPortionId double"


def test_several_precincts_go_by_the_first_vote_in_the_source(spark, tmp_path):
    rows = [("v1", "X", "A", False, 1.0), ("v1", "X", "B", True, 9.0), ("v2", "X", "A", True, 4.0), ("v1", "Y", "A", True, 2.0), ("v2", "Y", "B", True, 4.0), ("v1", "Z", "A", True, 5.0)]
    long = spark.createDataFrame(rows, LONG)
    long.coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    file = cvrfile.read(spark, str(tmp_path / "one.parquet"))
    assert [(r.imprinted, r.style) for r in file.ballots.orderBy("ord").collect()] == [("v1", "9"), ("v2", "4")]
    for name, some in (("b", rows[:3]), ("a", rows[3:])):  # files by name
        spark.createDataFrame(some, LONG).coalesce(1).write.parquet(str(tmp_path / f"two.parquet/part={name}"))
    places = longform.read(spark, str(tmp_path / "two.parquet"))
    assert {(r.voter_id, r.style) for r in longform.voters(places, longform.layout(places)).collect()} == {("v1", "2"), ("v2", "4")}
    with pytest.raises(Exception, match="several precincts"):
        longform.voters(long, longform.layout(long)).collect()
    none = spark.createDataFrame([("v1", "X", "A", True, None), ("v1", "Y", "A", True, 1.0)], LONG)
    none.coalesce(1).write.parquet(str(tmp_path / "none.parquet"))
    with pytest.raises(Exception, match="or none, of voter v1"):
        cvrfile.read(spark, str(tmp_path / "none.parquet")).ballots.collect()


def test_long_records_that_name_nothing_are_refused_and_names_are_matched_as_they_are(spark):
    good = [("v1", " X ", "A", True, 1.0), ("v1", "X", "A", True, 1.0), ("v2", "X", "B\t", True, 1.0)]
    long = spark.createDataFrame(good, LONG)
    of = longform.layout(long)
    assert [(c.contest, c.choice) for c in of.columns] == [("X", "A"), ("X", "A"), ("X", "B")]
    assert [r.cells for r in longform.ballots(long, of).orderBy("ord").collect()] == [["1", "1", "0"], ["", "0", "1"]]
    for what, row in (("voter_id", (None, "X", "A", True, 1.0)), ("contest", ("v3", " \t", "A", True, 1.0)), ("contest", ("v3", None, "A", True, 1.0)), ("candidate", ("v3", "X", None, True, 1.0)), ("isVote", ("v3", "X", "A", None, 1.0))):
        with pytest.raises(CvrError, match=f"without {what}"):
            longform.layout(spark.createDataFrame([*good, row], LONG))


def test_voters_without_contests_are_in_the_sheet(spark):
    b = make(spark, [("1", "s", ["1", "0", "", ""]), ("2", None, ["", "", "", ""]), ("3", "s", ["0", "1", "1", "0"])], 4)
    sheet = I.wide_sheet(I.ballot_probabilities(b, TWO, I.overall_probabilities(b, TWO)), TWO)
    assert [tuple(r) for r in sheet.orderBy("Voter").collect()] == [("V1", "s", "0.5000", "0.5000", "", ""), ("V2", "", "", "", "", ""), ("V3", "s", "0.5000", "0.5000", "1.000", "0.0000")]


def test_aggregates_and_blank_numbers_of_the_input_are_never_dropped(spark):
    rows = [("AGGREGATED-1", "s", ["1", "0", "", ""]), ("", "s", ["1", "0", "", ""]), (" 7 ", "s", ["1", "0", "", ""]), ("7", "s", ["1", "0", "", ""]), ("8", "s", ["1", "0", "", ""])]
    b = make(spark, rows, 4)
    gone = b.where("cvr_number in ('AGGREGATED-1', '', '7')")
    assert [r.cvr_number for r in R.without_aggregated(b, gone).orderBy("ord").collect()] == ["AGGREGATED-1", "", "8"]


def test_compat_releases_what_a_drained_donor_has_left(spark):
    rare = [(f"r{i}", "s", ["1", "0", "1", "0"]) for i in range(3)]
    donors = [(f"d{i}", "s", ["0", "1", "", ""]) for i in range(5)] + [(f"e{i}", "s", ["", "", "0", "1"]) for i in range(6)]
    own = make(spark, rare + donors, 4)
    for mode, least in (("compat", 1), ("spec", 4)):
        out = R.anonymize(own, TWO, Config(min_ballots=4, mode=mode))
        sizes = sorted(r.n for r in S.style_groups(S.with_style(out.ballots, TWO)).collect())
        assert sizes[0] >= least and not T.verify(own, out.output, TWO).where("difference <> 0").count()
        assert out.ballots.count() + 3 + sum(out.stats[f"ballots_{x}"] for x in ("borrowed_for_minimum", "added_for_contests", "added_for_balancing")) == len(rare + donors)


def test_long_numbers_sort_by_value(spark):
    numbers = ["1" + "0" * 39, "9" * 38, "2" + "0" * 38, "+5", "1_0", "AGGREGATED-1-x", "x"]
    assert [r.cvr_number for r in R.in_output_order(make(spark, [(n, "s", ["1"]) for n in numbers], 1)).collect()] == ["+5", "1_0", "9" * 38, "2" + "0" * 38, "1" + "0" * 39, "x", "AGGREGATED-1-x"]


def test_a_preamble_longer_than_the_first_read(spark, tmp_path):
    names = [f"contest {'x' * 60} {i}" for i in range(3000)]
    path = tmp_path / "wide.csv"
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([["E"], [""] * 8 + names, [""] * 8 + ["A"] * 3000, cvrfile.HEADER_NAMES + ["A"] * 3000, ["1"] * 8 + ["1"] * 3000])
    file = cvrfile.read(spark, str(path))
    assert len(file.layout.columns) == 3000 and file.layout.columns[-1].contest == names[-1] and file.ballots.count() == 1


def test_overvote_counts_first_choice(spark):
    own = I.overall_probabilities(make(spark, [("1", "s", ["1", "1", "", ""]), ("2", "s", ["0", "0", "", ""])], 4), TWO)
    assert {(r.choice, r.prob, r.undervote) for r in own.collect()} == {("A", 0.5, 0.5), ("B", 0.0, 0.5)}


def test_cli_reports_errors(spark, tmp_path, capsys):
    path = tmp_path / "short.csv"
    path.write_text("a\n")
    assert cli.main(["anonymize", str(path), str(tmp_path / "out.csv")]) == 1
    assert "Error:" in capsys.readouterr().err and not os.path.exists(tmp_path / "out.csv")
