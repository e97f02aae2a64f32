"""CVR files by byte ranges, records over quoted breaks, and releases written by executors."""

from __future__ import annotations

import csv
import glob
import io
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pollveil import cli
from pollveil.operators import release as R
from pollveil.plans.model import Config, CvrError
from pollveil.plans.store import numbered
from pollveil.sources import cvrfile, scan, sink
from pollveil.sources.synthetic import LAYOUT, synthetic_case
from tests.test_release import read_rows

PREAMBLE = [["Election", "V1"], [""] * 8 + ["X", "X"], [""] * 8 + ["A", "B"], [*cvrfile.HEADER_NAMES, "A", "B"]]


def content(terminator, n=40):
    """Ballots of which many hold quoted breaks, commas and quotes, with a blank and a short row."""
    rows = []
    for i in range(1, n + 1):
        odd = [f'say "{i}"', f"two\nlines {i}", f"three\n\nlines,{i}", f"plain {i}", '"', f"\n{i}"][i % 6]
        rows.append([str(i), "1", "1", odd, "im", "cg", f"s{i % 3}", f"t\n{i}" if i % 5 == 0 else "t", "1", "0"])
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerows(PREAMBLE)
    for i, row in enumerate(rows):
        writer.writerow(row)
        if i == 10:
            out.write("\r\n7,short\r\n")
    return out.getvalue().replace("\r\n", "\n").replace("\n", terminator)


def expected(text):
    rows = list(csv.reader(io.StringIO(text, newline=None)))[4:]
    return [(i, r[0] if r else "", r[6] if len(r) > 6 else "", r[3] if len(r) > 3 else "", r[8:], len(r)) for i, r in enumerate(rows, 1)]


def shown(ballots):
    return [tuple(r) for r in ballots.orderBy("ord").select("ord", "cvr_number", "style", "record", "cells", "n_fields").collect()]


@pytest.fixture
def many_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("terminator", ["\n", "\r\n", "\r"])
def test_ranges_give_the_rows_of_read_csv(spark, tmp_path, terminator):
    text, path = content(terminator), str(tmp_path / "in.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    want = expected(text)
    assert shown(cvrfile.read_csv(spark, path).ballots) == want
    size = len(text.encode())
    for ranges in (1, 3, 50):
        file = scan.scan_csv(spark, path, range_bytes=-(-size // ranges))
        assert file.ballots.rdd.getNumPartitions() in (ranges, ranges - 1)
        assert shown(file.ballots) == want
        assert file.preamble == PREAMBLE and file.terminator == terminator


def test_every_boundary_between_ranges(spark, tmp_path):
    text, path = content("\r\n", 8), str(tmp_path / "in.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    want = [(n - 1, r) for n, r in enumerate(csv.reader(io.StringIO(text, newline=None)), 1)]
    size = len(text.encode())
    for at in range(1, size):  # each range's state from the text before it, as the chain gives it
        states = []
        for a, b in ((0, at), (at, size)):
            inside, place = False, 0
            with open(path, "rb") as stream:
                for offset, line in scan.physical_lines(stream, 0, chunk=7):
                    if offset >= a:
                        break
                    place += not inside
                    inside = scan.follows(line, inside)
            states.append(scan.ByteRange(path, a, b, inside, place))
        assert [x for r in states for x in scan.range_records(r)] == want


@settings(max_examples=60, deadline=None)
@given(st.text('ab",\n\r', max_size=40), st.integers(1, 9))
def test_lines_of_chunks_are_those_of_the_text(text, chunk):
    data, got = text.encode(), []
    for start in range(len(data) + 1):
        got = [line for offset, line in scan.physical_lines(io.BytesIO(data), start, chunk)]
        begins = [0] + [i + 1 for i in range(len(data)) if data[i : i + 1] == b"\n" or data[i : i + 1] == b"\r" and data[i + 1 : i + 2] != b"\n"]
        whole = [line.rstrip(b"\r\n") for line in data.splitlines(keepends=True)]
        assert got == [line for at, line in zip(begins, whole, strict=False) if at >= start]


def test_filters_reach_the_tasks(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w", newline="") as f:
        f.write(content("\n"))
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        every = scan.ballots(spark, path, range_bytes=300)
        got = every.where("style = 's1' and cvr_number in ('1', '4', '5')")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan and sorted(r.cvr_number for r in got.collect()) == ["1", "4"]
        assert every.where("style = 's1' and ord < 9").count() == 3
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_a_quote_that_is_never_closed(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w", newline="") as f:
        f.write(content("\n", 4) + '9,"open\n')
    for read in (cvrfile.read_csv, scan.scan_csv):
        with pytest.raises(CvrError, match="never closed"):
            read(spark, path).ballots.count()


def test_records_over_several_partitions(spark, many_partitions):
    text = content("\n", 60)
    lines = spark.createDataFrame(list(enumerate(text.split("\n")[:-1], 1)), "at long, value string").repartitionByRange(7, "at")
    with_break = cvrfile.records(numbered(lines, "at").select("ord", "value"))
    got = [next(csv.reader(io.StringIO(r.value, newline="")), []) for r in with_break.orderBy("ord").collect()]
    assert got == list(csv.reader(io.StringIO(text, newline="")))
    assert numbered(lines, "at").rdd.getNumPartitions() > 1


@pytest.mark.parametrize("terminator", ["\n", "\r\n"])
def test_a_release_of_several_parts_is_the_single_file(spark, tmp_path, many_partitions, terminator):
    release = R.anonymize(synthetic_case(spark), LAYOUT, Config())
    preamble = cvrfile.preamble_of(LAYOUT, 'Election, "quoted"')
    one, many = str(tmp_path / "one.csv"), str(tmp_path / "many")
    cvrfile.write_csv(release.output, preamble, one, terminator)
    sink.write_release(release.output, preamble, many, terminator)
    parts = sorted(glob.glob(f"{many}/part-*"))
    assert len(parts) > 3 and os.path.exists(f"{many}/_SUCCESS") and len(os.listdir(tmp_path)) == 2
    assert b"".join(open(p, "rb").read() for p in parts) == open(one, "rb").read()
    assert shown(scan.scan_csv(spark, many).ballots) == shown(cvrfile.read_csv(spark, one).ballots)
    with pytest.raises(CvrError, match="already"):
        sink.write_release(release.output, preamble, many)


def test_a_failed_task_leaves_no_release(spark, tmp_path):
    rows = synthetic_case(spark).withColumn("cells", F.when(F.col("ord") == 7, F.array(F.raise_error(F.lit("lost")))).otherwise(F.col("cells"))).repartition(4)
    with pytest.raises(Exception, match="lost"):
        sink.write_release(rows, PREAMBLE, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_the_command_writes_parts(spark, tmp_path):
    source, out = str(tmp_path / "in.csv"), str(tmp_path / "out")
    cvrfile.write_csv(synthetic_case(spark), cvrfile.preamble_of(LAYOUT), source)
    cli.anonymize(spark, source, str(tmp_path / "one.csv"), Config())
    cli.anonymize(spark, source, out, Config(), parts=True, range_bytes=200)
    rows = [r for p in sorted(glob.glob(f"{out}/part-*")) for r in read_rows(p)]
    assert rows == read_rows(str(tmp_path / "one.csv"))


def test_sheets_of_several_parts_are_the_single_files(spark, tmp_path, many_partitions):
    source, one, many = str(tmp_path / "in.csv"), tmp_path / "one", tmp_path / "many"
    cvrfile.write_csv(synthetic_case(spark).withColumn("style", F.concat("style", F.lit(', "x"'))), cvrfile.preamble_of(LAYOUT), source)
    one.mkdir()
    many.mkdir()
    cli.guess(spark, source, None, 5, folder=str(one))
    paths = cli.guess(spark, source, None, 5, folder=str(many), parts=True)
    for path in paths:
        parts = sorted(glob.glob(f"{path}/part-*"))
        assert len(parts) > 3
        assert b"".join(open(p, "rb").read() for p in parts) == open(one / os.path.basename(path), "rb").read()
