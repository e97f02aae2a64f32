"""CVR files read by byte ranges: the data source `cvr`.

A range holds the lines that begin in it. Whether its first line begins inside a quoted field depends on all bytes before,
so a first pass over the ranges finds, for either state at a range's begin, the state at its end and how many records begin
in it; these answers, one a range, are chained by a running composition, which gives each range its state and the place of
its first record. The scan then reads ranges independently: a task skips the lines of a record that began before its
range, and reads past its end for one that goes on. Filters on style and CVR number reach the tasks, where rows that fail
them are never built (where spark.sql.python.filterPushdown.enabled is on when the source is made)."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from pollveil.plans.model import BALLOT_SCHEMA, HEADER, Config, CvrError, Layout
from pollveil.sources.cvrfile import CvrFile, ends_inside, line_terminator, read_preamble
from pollveil.sources.files import locate, parts

NAME, PREAMBLE_ROWS = "cvr", 4
RANGE_BYTES, CHUNK, BATCH = 64 << 20, 4 << 20, 4096


def physical_lines(stream, start: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines that begin at `start` or later. Lines end at LF, CRLF or CR."""
    at = max(0, start - 1)  # the byte before tells whether a line begins at start
    stream.seek(at)
    skip, rest = start > 0, b""
    while True:
        data = stream.read(chunk)
        lines = (rest + data).splitlines(keepends=True)
        rest = lines.pop() if data and lines and not lines[-1].endswith(b"\n") else b""  # a CR may have its LF in the next chunk
        for line in lines:
            if not skip:
                yield at, line.rstrip(b"\r\n")
            skip = False
            at += len(line)
        if not data:
            return


def follows(line: bytes, inside: bool) -> bool:
    """Whether a line that begins inside a quoted field, or not, ends inside one."""
    return ends_inside(line.decode("latin-1"), inside) if b'"' in line else inside


@dataclass
class ByteRange(InputPartition):
    file: str
    begin: int
    end: int
    inside: bool = False  # whether its first line is in a record that began before
    first: int = 0  # the place of the first record that begins in it


def cut_ranges(path: str, range_bytes: int) -> list[ByteRange]:
    return [ByteRange(file, a, min(a + range_bytes, size)) for file, size in parts(path) for a in range(0, size, range_bytes)]


def chained(spark: SparkSession, ranges: list[ByteRange]) -> list[ByteRange]:
    """The ranges with their states: one job, and one row a range for the driver to chain."""
    if not ranges:
        return ranges

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                r, state, begun = ranges[i], [False, True], [0, 0]
                store, at = locate(r.file)
                with store.open_input_file(at) as stream:
                    for offset, line in physical_lines(stream, r.begin):
                        if offset >= r.end:
                            break
                        begun = [n + (not s) for n, s in zip(begun, state, strict=True)]
                        if b'"' in line:
                            state = [follows(line, s) for s in state]
                yield pa.RecordBatch.from_pydict({"i": [i], "state": [state], "begun": [begun]})

    found = spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(ends, "i long, state array<boolean>, begun array<long>").collect()
    inside, place, out = False, 0, []
    for r, own in zip(ranges, sorted(found), strict=True):
        out.append(ByteRange(r.file, r.begin, r.end, inside, place))
        place += own.begun[inside]
        inside = own.state[inside]
    if inside:
        raise CvrError("a quoted field is never closed")
    return out


def range_records(r: ByteRange) -> Iterator[tuple[int, list[str]]]:
    """(place, fields) of the records that begin in a range."""
    store, at = locate(r.file)
    with store.open_input_file(at) as stream:
        inside, place, held = r.inside, r.first - 1, None
        for offset, line in physical_lines(stream, r.begin):
            if held is None and offset >= r.end:
                return
            if held is None and inside:  # of a record of an earlier range
                if offset >= r.end:
                    return
                inside = follows(line, True)
                continue
            if held is None:
                place += 1
                if b'"' not in line:
                    yield place, line.decode("utf-8", "replace").split(",") if line else []
                    continue
                held = []
            held.append(line)
            inside = follows(line, inside)
            if not inside:
                text, held = b"\n".join(held).decode("utf-8", "replace"), None
                yield place, next(csv.reader([text + "\n"] if "\n" not in text else text.splitlines(keepends=True)), [])


class CvrReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.header = options["path"], int(options.get("header_length", "8"))
        self.places = {"style": int(options.get("style_column", "6")), "ballot_type": int(options.get("ballot_type", "7"))}
        plan = options.get("ranges")
        self.ranges = [ByteRange(*r) for r in json.loads(plan)] if plan else None
        self.wanted: list[tuple[str, set[str]]] = []

    def partitions(self) -> list[ByteRange]:
        """Those of the `ranges` option; without it each file is one, which is right where no quoted field crosses files."""
        if self.ranges is not None:
            return self.ranges
        found = cut_ranges(self.path, 1 << 62)
        if len(found) > 1:
            raise CvrError("several files need the option ranges")
        return found

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        place = {c: self.places.get(c, i) for i, c in enumerate(HEADER)}
        rows: list[tuple[int, list[str]]] = []
        for at, fields in range_records(partition):
            if at >= PREAMBLE_ROWS and all((fields[place[c]] if place[c] < len(fields) else "") in values for c, values in self.wanted):
                rows.append((at - PREAMBLE_ROWS + 1, fields))
                if len(rows) == BATCH:
                    yield self._batch(rows, place)
                    rows = []
        if rows:
            yield self._batch(rows, place)

    def _batch(self, rows: list[tuple[int, list[str]]], place: dict[str, int]) -> pa.RecordBatch:
        named = {c: pa.array([f[k] if k < len(f) else "" for _, f in rows], pa.string()) for c, k in place.items()}
        cells = pa.array([f[self.header :] for _, f in rows], pa.list_(pa.string()))
        return pa.RecordBatch.from_pydict({"ord": pa.array([n for n, _ in rows], pa.int64()), **named, "cells": cells, "n_fields": pa.array([len(f) for _, f in rows], pa.int32())})


class FilteringReader(CvrReader):
    """Spark refuses a reader that takes filters where the session does not hand them out."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  (the interface's name)
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in ("style", "cvr_number"):
                self.wanted.append((name, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f


class CvrSource(DataSource):
    """Options: path, ranges (as `ballots` makes them), header_length, style_column, ballot_type, filters (true where the
    session pushes filters to Python sources)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return BALLOT_SCHEMA

    def reader(self, schema: StructType) -> CvrReader:
        return (FilteringReader if self.options.get("filters") == "true" else CvrReader)(dict(self.options))


def ballots(spark: SparkSession, path: str, config: Config | None = None, range_bytes: int = RANGE_BYTES, ballot_type: int = 7) -> DataFrame:
    """The ballots of a CVR file, or of a folder of parts in the order of their names."""
    config = config or Config()
    spark.dataSource.register(CvrSource)
    ranges = chained(spark, cut_ranges(path, range_bytes))
    plan = json.dumps([[r.file, r.begin, r.end, r.inside, r.first] for r in ranges])
    own = spark.read.format(NAME).option("path", path).option("ranges", plan).option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    return own.option("header_length", config.header_length).option("style_column", config.style_column).option("ballot_type", ballot_type).load()


def scan_csv(spark: SparkSession, path: str, config: Config | None = None, range_bytes: int = RANGE_BYTES) -> CvrFile:
    """As cvrfile.read_csv, by byte ranges; a folder of parts, as a release is written, is read as one file."""
    config = config or Config()
    found = parts(path)
    if not found:
        raise CvrError(f"{path}: no files")
    preamble, first = read_preamble(spark, found[0][0])
    contests, choices, headers = preamble[1:]
    n = config.header_length
    layout = Layout.of([(contests[i], choices[i] if i < len(choices) else None) for i in range(n, max(len(contests), n))])
    named = next((i for i, h in enumerate(headers) if h.strip().lower() == "ballottype"), None)
    return CvrFile(ballots(spark, path, config, range_bytes, named if named is not None and named < n else 7), layout, preamble, line_terminator(first), named)
