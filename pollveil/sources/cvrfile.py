"""CVR files: four preamble rows (election, contests, choices, headers), then ballots; rows may be ragged.

The preamble is read on the driver; ballots are lines of a text source, numbered in file order. Lines without quotes are
split by Spark; others go through a small parser. A quoted field may hold line breaks: whether a line begins inside a
quoted field depends on all lines before it, so each partition tells in which state it ends for either state at its
begin, the driver chains these answers (one for each partition), and lines of one record are then joined."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pollveil.plans.model import HEADER, Config, CvrError, Layout
from pollveil.plans.store import numbered
from pollveil.sources import longform

#: The header names of a CVR file.
HEADER_NAMES = ["CvrNumber", "TabulatorNum", "BatchId", "RecordId", "ImprintedId", "CountingGroup", "PrecinctPortion", "BallotType"]
#: Bytes that are read for the preamble at first (four times as many while it is not whole), and for line ends.
PREAMBLE_BYTES, SNIFF_BYTES = 1 << 16, 1024


def is_parquet(path: str) -> bool:
    return path.lower().endswith(".parquet")


def head(spark: SparkSession, path: str, n: int = PREAMBLE_BYTES) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def line_terminator(first: bytes) -> str:
    """CRLF before LF before CR; LF where there is none."""
    sample = first[:SNIFF_BYTES]
    return next((t.decode() for t in (b"\r\n", b"\n", b"\r") if t in sample), "\n")


@dataclass
class CvrFile:
    ballots: DataFrame
    layout: Layout
    preamble: list[list[str]]
    terminator: str
    ballot_type: int | None  # its place in a row, if the headers name it


def read_preamble(spark: SparkSession, path: str) -> tuple[list[list[str]], bytes]:
    """The four rows, however long, and the file's first bytes."""
    size = PREAMBLE_BYTES
    while True:
        first = head(spark, path, size)
        rows = list(islice(csv.reader(io.StringIO(first.decode("utf-8", "replace"), newline=None)), 5))
        if len(rows) == 5 or len(first) < size:
            break
        size *= 4
    if len(rows) < 4:
        raise CvrError(f"{path}: a CVR file begins with four rows, this one has {len(rows)}")
    return rows[:4], first


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted field, or not, ends inside one. Only a field's first character opens."""
    i, n = 0, len(line)
    if not inside and line.startswith('"'):
        i, inside = 1, True
    while True:
        while inside:
            i = line.find('"', i)
            if i < 0:
                return True
            inside, i = line.startswith('"', i + 1), i + 1  # two quotes stand for one
            i += inside
        i = line.find(",", i)
        if i < 0 or i + 1 >= n:
            return False
        i += 1
        if line[i] == '"':
            i, inside = i + 1, True


def records(lines: DataFrame) -> DataFrame:
    """(ord, value): the records that lines (ord, value; sorted within partitions that follow each other) make up, with
    line breaks between a record's lines."""

    def follow(line: str, place: int, begun: int | None) -> int | None:
        """Where the record began that a line leaves open; None where it leaves none. `begun`: the same before it."""
        if begun is None:
            return place if '"' in line and ends_inside(line, False) else None
        return begun if '"' not in line or ends_inside(line, True) else None

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, state, several = None, [None, -1], [False, True]  # -1: begun in an earlier partition
        for batch in batches:
            for place, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = place if first is None else first
                if '"' in line:
                    state = [follow(line, place, x) for x in state]
                    several = [a or x is not None for a, x in zip(several, state, strict=True)]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), first)] + [pa.array([state]), pa.array([several])], ["part", "first", "state", "several"])

    own = lines.select("ord", "value")
    begun, begins, any_several = None, {}, False
    for r in sorted(own.mapInArrow(ends, "part long, first long, state array<long>, several array<boolean>").collect(), key=lambda r: r["first"]):  # a row for each partition
        begins[r.part] = begun
        any_several |= r.several[begun is not None]
        now = r.state[begun is not None]
        begun = begun if now == -1 else now
    if begun is not None:
        raise CvrError("a quoted field is never closed")
    if not any_several:
        return own

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = begins.get(TaskContext.get().partitionId())
        for batch in batches:
            record, single = [], []
            for place, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before, begun = begun, follow(line, place, begun)
                record.append(place if before is None else before)
                single.append(before is None and begun is None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(record, pa.int64()), pa.array(single, pa.bool_())], ["ord", "value", "record", "single"])

    marked = own.mapInArrow(mark, "ord long, value string, record long, single boolean")
    whole = marked.where("not single").groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x.value), "\n").alias("value"))
    joined = marked.where("single").select(F.col("record").alias("__line"), "value").unionAll(whole.select(F.col("record").alias("__line"), "value"))
    return numbered(joined, "__line").select("ord", "value")


@F.pandas_udf(ArrayType(StringType()))
def _parse(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in lines:
        yield pd.Series([None if x is None else next(csv.reader(io.StringIO(x, newline="")), []) for x in batch], dtype=object)


def split_line(line: Column) -> Column:
    quoted = line.contains('"')
    return F.when(line == "", F.expr("cast(array() as array<string>)")).when(quoted, _parse(F.when(quoted, line))).otherwise(F.split(line, ","))


def read_csv(spark: SparkSession, path: str, config: Config | None = None) -> CvrFile:
    """Blank lines are rows with no field. Rows end at LF, CRLF or CR; within quotes these are part of the field, as LF.
    A file without a whole preamble, or with a quoted field that is never closed, is refused."""
    config = config or Config()
    preamble, first = read_preamble(spark, path)
    contests, choices, headers = preamble[1:]
    n = config.header_length
    width = max(len(contests), n)
    layout = Layout.of([(contests[i], choices[i] if i < len(choices) else None) for i in range(n, width)])
    ballot_type = next((i for i, h in enumerate(headers) if h.strip().lower() == "ballottype"), None)

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__line"))
    rows = records(numbered(lines, "__file", "__start", "__line")).where("ord > 4").select((F.col("ord") - 4).alias("ord"), split_line(F.col("value")).alias("fields"))
    places = {"style": config.style_column, "ballot_type": ballot_type if ballot_type is not None and ballot_type < n else 7}
    named = [F.coalesce(F.get("fields", F.lit(places.get(c, i))), F.lit("")).alias(c) for i, c in enumerate(HEADER)]
    cells = F.when(F.size("fields") > n, F.slice("fields", n + 1, F.greatest(F.size("fields") - n, F.lit(1)))).otherwise(F.expr("cast(array() as array<string>)"))
    return CvrFile(rows.select("ord", *named, cells.alias("cells"), F.size("fields").alias("n_fields")), layout, preamble, line_terminator(first), ballot_type)


def read_parquet(spark: SparkSession, path: str) -> CvrFile:
    long = longform.read(spark, path)
    layout = longform.layout(long)
    return CvrFile(longform.ballots(long, layout), layout, preamble_of(layout), "\n", 7)


def read(spark: SparkSession, path: str, config: Config | None = None) -> CvrFile:
    return read_parquet(spark, path) if is_parquet(path) else read_csv(spark, path, config)


def preamble_of(layout: Layout, title: str = "Parquet CVR") -> list[list[str]]:
    blanks = [""] * len(HEADER)
    choices = [c.choice for c in layout.columns]
    return [[title, "V1", *blanks[2:]], blanks + [c.contest for c in layout.columns], blanks + choices, HEADER_NAMES + choices]


def _quoted(field: Column) -> Column:
    return F.when(field.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def as_lines(rows: DataFrame) -> DataFrame:
    """rows as CSV lines with as many fields as they had; rows without any are dropped."""
    every = F.concat(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in HEADER)), "cells")
    own = rows.where("n_fields > 0").select(F.transform(F.slice(every, F.lit(1), F.col("n_fields")), _quoted).alias("f"))
    return own.select(F.array_join("f", ",").alias("value"))


def write_csv(rows: DataFrame, preamble: list[list[str]], path: str, terminator: str = "\n") -> None:
    """One local file: the preamble as it was, then rows in their order, streamed partition by partition. It appears
    under its name only once it is whole. Releases too large for one file are written by `sink.write_release`."""
    staged = f"{path}.part"
    with open(staged, "w", encoding="utf-8", newline="") as out:
        csv.writer(out, lineterminator=terminator).writerows(preamble)
        for r in as_lines(rows).toLocalIterator():
            out.write(r.value + terminator)
    os.replace(staged, path)


def in_voter_order(sheet: DataFrame) -> DataFrame:
    return sheet.orderBy(F.substring("Voter", 2, 20).cast("long"))


def sheet_lines(sheet: DataFrame) -> DataFrame:
    """A probability sheet as CSV lines in the voters' order."""
    ordered = in_voter_order(sheet)
    names = [f"c{i}" for i in range(len(sheet.columns))]  # choices of two contests may be named alike
    return ordered.toDF(*names).select(F.concat_ws(",", *(_quoted(F.coalesce(F.col(n), F.lit(""))) for n in names)).alias("value"))


def write_sheet(sheet: DataFrame, path: str) -> None:
    """A probability sheet in the voters' order as one local file. Those too large for one are written by
    `sink.write_sheet_parts`."""
    with open(f"{path}.part", "w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(sheet.columns)
        for r in in_voter_order(sheet).toLocalIterator():
            writer.writerow(list(r))
    os.replace(f"{path}.part", path)
