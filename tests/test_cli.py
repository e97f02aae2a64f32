"""The command line: reports, errors, targets."""

from __future__ import annotations

import os

import pytest

from pollveil import cli
from pollveil.plans.model import Config
from pollveil.sources import cvrfile
from pollveil.sources.synthetic import LAYOUT, synthetic_case
from tests.test_release import read_rows


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "in.csv")
    cvrfile.write_csv(synthetic_case(spark), cvrfile.preamble_of(LAYOUT), path)
    return path


def tables(text):
    """title -> rows of the tables that a command prints."""
    out = {}
    for line in text.splitlines():
        own = line.split("\t")
        if line.startswith("# "):
            rows = out.setdefault(own[0][2:], [])
        else:
            rows.append(own)
    return out


def test_reports_of_the_test_election(spark, source, tmp_path, capsys):
    assert cli.main(["anonymize", source, str(tmp_path / "out.csv"), "-s"]) == 0
    got = tables(capsys.readouterr().out)
    assert got["CVR styles"] == [["1R1", "1", "1R2"], ["1S3", "10", "1S1"], ["2S2", "10", "2S3"]]
    assert got["Votes"] == [["A", "A0", "7"], ["A", "A1", "4"], ["B", "B0", "11"], ["B", "B1", "9"]]
    assert ["2S3", "11", "10", "A", "A0", "0.6000"] in got["Style statistics"] and len(got["Style statistics"]) == 8
    (released,) = (rows for title, rows in got.items() if title.startswith("Released to"))
    assert dict(released) == {"rows read": "21", "styles before": "3", "styles after": "2", "minimum": "10", "ballots of rare styles": "1", "added for the minimum": "10", "added for contests": "0", "added against unanimity": "0", "added for the entropy rule": "0", "ballots in the aggregate": "11", "aggregate rows": "1"}
    assert got["Rare styles"] == [["1R2", "1", "1R1:1"]]
    assert got["Contests of the aggregate"] == [["A", "11", "11", "11", "11", "0", "", "A0=1", "A0=7 A1=4"], ["B", "10", "10", "10", "10", "0", "", "", "B0=5 B1=5"]]


def test_statistics_of_styles(spark, source, tmp_path, capsys):
    release = cli.anonymize(spark, source, str(tmp_path / "out.parquet"), Config())
    stats = release.all_stats()
    assert stats["style_counts"] == {"1R1": 1, "1S3": 10, "2S2": 10}
    assert stats["rare_style_counts"] == [{"descriptive_name": "1R2", "ballot_count": 1, "original_styles": [("1R1", 1)]}]
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 11


@pytest.mark.parametrize("name", ["missing.csv", "missing.parquet"])
def test_any_failure_is_an_error_and_exit_code_1(spark, tmp_path, capsys, name):
    assert cli.main(["anonymize", str(tmp_path / name), str(tmp_path / "out.csv")]) == 1
    err = capsys.readouterr().err
    assert [x for x in err.splitlines() if x.startswith("Error: ") and len(x) > 10] and "Traceback" not in err
    assert cli.main(["guess", str(tmp_path / name)]) == 1 and os.listdir(tmp_path) == []


def test_errors_raised_within_spark(spark, tmp_path, capsys):
    rows = [("v1", "X", "A", True, None), ("v2", "X", "A", True, 1.0)]
    spark.createDataFrame(rows, "voter_id string, contest string, candidate string, isVote boolean, precinctPortionId double").write.parquet(str(tmp_path / "in.parquet"))
    assert cli.main(["anonymize", str(tmp_path / "in.parquet"), str(tmp_path / "out.csv")]) == 1
    assert "several precincts, or none, of voter v1" in capsys.readouterr().err and not os.path.exists(tmp_path / "out.csv")


def test_guess_prints_its_sheets(spark, source, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["guess", source, "-m", "5"]) == 0
    assert [os.path.basename(p) for p in capsys.readouterr().out.split()] == cli.SHEETS
    assert all(len(read_rows(str(tmp_path / p))) == 22 for p in cli.SHEETS)
