"""A release written by executors: the data source `cvr_release`.

Each task writes its partition as one file of CSV lines into a pending folder beside the target. The commit puts the
preamble in front, names the parts in the partitions' order, drops what failed or doubled attempts left behind, and
renames the folder: the target appears as a whole or not at all. Read in the order of their names, the parts are the bytes of
the single file. No row passes through the driver."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from pollveil.plans.model import CvrError
from pollveil.sources.cvrfile import as_lines, sheet_lines
from pollveil.sources.files import locate

NAME = "cvr_release"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    rows: int


class ReleaseWriter(DataSourceArrowWriter):
    def __init__(self, path: str, preamble: str, terminator: str):
        self.path, self.preamble, self.terminator = path.rstrip("/"), preamble, terminator
        self.pending = f"{self.path}.pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        name, rows = f"task-{task.partitionId()}-{task.taskAttemptId()}", 0
        store, at = locate(self.pending)
        store.create_dir(at)
        with store.open_output_stream(f"{at}/{name}") as out:
            for batch in iterator:
                lines = batch.column(0).to_pylist()
                if lines:
                    out.write((self.terminator.join(lines) + self.terminator).encode())
                    rows += len(lines)
        return Part(task.partitionId(), name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, at = locate(self.pending)
        store.create_dir(at)
        with store.open_output_stream(f"{at}/part-00000.csv") as out:
            out.write(self.preamble.encode())
        kept = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        for k, m in enumerate(kept, 1):
            store.move(f"{at}/{m.file}", f"{at}/part-{k:05d}.csv")
        from pyarrow import fs

        for left in store.get_file_info(fs.FileSelector(at)):
            if left.base_name.startswith("task-"):
                store.delete_file(left.path)
        with store.open_output_stream(f"{at}/_SUCCESS"):
            pass
        store.move(at, locate(self.path)[1])

    def abort(self, messages: list[Part | None]) -> None:
        store, at = locate(self.pending)
        store.delete_dir_contents(at, missing_dir_ok=True)
        if store.get_file_info(at).type.name == "Directory":
            store.delete_dir(at)


class ReleaseSink(DataSource):
    """Options: path, preamble (text), terminator. The rows have one column, the lines."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> ReleaseWriter:
        if len(schema) != 1:
            raise ValueError("a release is written as one column of lines")
        return ReleaseWriter(self.options["path"], self.options.get("preamble", ""), self.options.get("terminator", "\n"))


def preamble_text(preamble: list[list[str]], terminator: str) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator=terminator).writerows(preamble)
    return out.getvalue()


def write_lines(lines: DataFrame, head: str, path: str, terminator: str = "\n") -> None:
    """lines (one column, in their order) as a folder of parts behind head. A target that is there already is refused."""
    store, at = locate(path)
    if store.get_file_info(at).type.name != "NotFound":
        raise CvrError(f"{path} is there already")
    lines.sparkSession.dataSource.register(ReleaseSink)
    lines.write.format(NAME).mode("append").option("path", path).option("preamble", head).option("terminator", terminator).save()


def write_release(rows: DataFrame, preamble: list[list[str]], path: str, terminator: str = "\n") -> None:
    """rows (in their order) as a folder of parts behind the preamble."""
    write_lines(as_lines(rows), preamble_text(preamble, terminator), path, terminator)


def write_sheet_parts(sheet: DataFrame, path: str) -> None:
    """A probability sheet in the voters' order as a folder of parts behind its header."""
    write_lines(sheet_lines(sheet), preamble_text([sheet.columns], "\n"), path)
