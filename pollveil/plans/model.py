"""Data model: ballots are rows with header fields and an array of vote cells; the layout says what each cell means.

A cell is a string: empty if the contest is not on the ballot, 0 if it is and the choice was not taken, 1 if it was.
`ord` is a ballot's place in its file; wherever order decides (ties, first rows), it decides by `ord`."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

HEADER = ["cvr_number", "tabulator", "batch", "record", "imprinted", "counting_group", "style", "ballot_type"]
BALLOT_SCHEMA = "ord long, " + ", ".join(f"{c} string" for c in HEADER) + ", cells array<string>, n_fields int"
AGGREGATE_PREFIX = "AGGREGATED-"


class CvrError(ValueError):
    """Input that cannot be released: what is wrong is in the message."""


@dataclass(frozen=True)
class Config:
    """mode: spec does what the requirements ask for; compat keeps the historical behaviour, defects included. entropy: the
    aggregate also gets ballots for the entropy rule."""

    min_ballots: int = 10
    style_column: int = 6
    header_length: int = 8
    mode: str = "spec"
    entropy: bool = False

    def __post_init__(self):
        if self.mode not in ("spec", "compat"):
            raise ValueError("mode must be spec or compat")


@dataclass(frozen=True)
class VoteColumn:
    index: int  # from 0, over the vote cells
    contest: str
    choice: str
    named: bool = True  # whether the choices row reaches this column; tallies leave out the others


@dataclass(frozen=True)
class Layout:
    """The vote columns. A layout is as wide as a ballot and lives on the driver."""

    columns: tuple[VoteColumn, ...]
    keys: tuple[tuple, ...] = field(default=(), compare=False)  # names as they stand in long records

    @classmethod
    def of(cls, pairs: list[tuple[str, str | None]]) -> Layout:
        """pairs: contest and choice of each column; a choice of None is one that the choices row does not reach."""
        named = lambda i, choice: f"Choice{i + len(HEADER)}" if choice is None else choice.strip()
        return cls(tuple(VoteColumn(i, contest.strip(), named(i, choice), choice is not None) for i, (contest, choice) in enumerate(pairs)), tuple(pairs))

    @property
    def contests(self) -> dict[str, list[int]]:
        """Columns of each contest, in order of first appearance; columns without a contest's name belong to none."""
        found: dict[str, list[int]] = {}
        for c in self.columns:
            if c.contest:
                found.setdefault(c.contest, []).append(c.index)
        return found

    @property
    def sorted_contests(self) -> list[tuple[str, list[int]]]:
        return sorted(self.contests.items())

    def choice_name(self, index: int) -> str:
        """The choice's name, or one made of the column's place in the file's row where it is blank."""
        return self.columns[index].choice or f"Choice{index + len(HEADER)}"

    def frame(self, spark: SparkSession, blank_names: bool = True, beyond: bool = True) -> DataFrame:
        """col_idx, contest, choice of columns that belong to a contest: a small dimension table. blank_names: choices
        without a name stay so, else they get one; beyond: with the columns that the choices row does not reach."""
        rows = [(c.index, c.contest, c.choice if blank_names else self.choice_name(c.index)) for c in self.columns if c.contest and (beyond or c.named)]
        return spark.createDataFrame(rows, "col_idx int, contest string, choice string")
