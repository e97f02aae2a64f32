"""Long vote records (voter_id, contest, candidate, isVote, precinctPortionId) as ballots.

A voter with no true isVote row is on no ballot, and a contest counts as present if the voter has a vote in it. Votes are
matched with columns by their names as they are, white space included; a column's contest and choice are shown without
it. What names no voter, contest or candidate is refused.

A voter's style is the precinct of the voter's first vote in the source. Records have an order where they come from files
(`read`): file by file, and by place in the file, which Spark knows as metadata and min_by carries through the grouping.
Records without an order must name one precinct a voter. Both modes of a release go by this."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.plans.model import HEADER, CvrError, Layout
from pollveil.plans.store import numbered

REQUIRED = ["voter_id", "contest", "candidate", "isVote", "precinctPortionId"]


#: Column with a record's place in its source.
PLACE = "__place"


def file_place() -> Column:
    """A record's place among the files that it is read from."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Long records of Parquet files, with their places."""
    return spark.read.parquet(path).select("*", file_place().alias(PLACE))


def check_columns(df: DataFrame) -> None:
    if missing := sorted(set(REQUIRED) - set(df.columns)):
        raise CvrError(f"missing columns {missing}; found {df.columns}")


def votes(long: DataFrame) -> DataFrame:
    check_columns(long)
    return long.where("isVote")


def layout(long: DataFrame) -> Layout:
    """Contests and their candidates, sorted: what is collected is as wide as a ballot. Raises CvrError for rows that
    cannot be counted: no voter, no contest (or a blank one), no candidate, or no telling whether it is a vote."""
    check_columns(long)
    rows = long.where("coalesce(isVote, true)").groupBy("contest", "candidate").agg(F.count_if(F.col("isVote").isNull()).alias("unclear"), F.count_if(F.col("voter_id").isNull()).alias("nobody"))
    found = rows.orderBy("contest", "candidate").collect()
    for what, bad in (("isVote", [r for r in found if r.unclear]), ("voter_id", [r for r in found if r.nobody]), ("contest", [r for r in found if r.contest is None or not str(r.contest).strip()]), ("candidate", [r for r in found if r.candidate is None])):
        if bad:
            raise CvrError(f"a vote without {what}: contest {bad[0].contest!r}, candidate {bad[0].candidate!r}")
    return Layout.of([(str(r.contest), str(r.candidate)) for r in found])


def voters(long: DataFrame, of: Layout) -> DataFrame:
    """voter_id, style (the precinct of the voter's first vote), columns (those the voter has a vote in). Raises, once it
    runs, where that vote names no precinct, or where votes without places name several."""
    columns = long.sparkSession.createDataFrame([(contest, candidate, i) for i, (contest, candidate) in enumerate(of.keys)], "__contest string, __candidate string, col_idx int")
    own = votes(long).join(F.broadcast(columns), (F.col("contest").cast("string") == F.col("__contest")) & (F.col("candidate").cast("string") == F.col("__candidate")))  # as wide as a ballot
    if PLACE in long.columns:
        grouped = own.groupBy("voter_id").agg(F.min_by("precinctPortionId", PLACE).alias("low"), F.collect_set("col_idx").alias("columns"))
        good = F.col("low").isNotNull()
    else:
        grouped = own.groupBy("voter_id").agg(F.min("precinctPortionId").alias("low"), F.max("precinctPortionId").alias("high"), F.collect_set("col_idx").alias("columns"))
        good = F.col("low") == F.col("high")
    style = F.when(good, F.col("low").cast("bigint").cast("string")).otherwise(F.raise_error(F.concat(F.lit("several precincts, or none, of voter "), F.col("voter_id").cast("string"))))
    return grouped.select("voter_id", style.alias("style"), "columns")


def numbered_voters(long: DataFrame, of: Layout | None = None) -> DataFrame:
    """voters with ord, their number in the order of their ids."""
    return numbered(voters(long, of or layout(long)), "voter_id")


def ballots(long: DataFrame, of: Layout, in_order: bool = True) -> DataFrame:
    """Ballots numbered by sorted voter_id: one shuffle by voter, one by ranges for the numbers. Without in_order there
    are no numbers (ord and the fields made of it are null) and no second shuffle; tallies and styles need none."""
    groups: dict[str, list[int]] = {}
    for i, (contest, _) in enumerate(of.keys):
        groups.setdefault(contest, []).append(i)
    present = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(groups[contest]).alias("own")) for i, (contest, _) in enumerate(of.keys)))
    cells = F.transform(present, lambda k: F.when(F.array_contains("columns", k.i), "1").when(F.arrays_overlap("columns", k.own), "0").otherwise("")) if of.keys else F.expr("cast(array() as array<string>)")
    rows = numbered_voters(long, of) if in_order else voters(long, of).withColumn("ord", F.lit(None).cast("long"))
    number = F.col("ord").cast("string")
    return rows.select("ord", number.alias("cvr_number"), F.lit("1").alias("tabulator"), F.lit("1").alias("batch"), number.alias("record"), F.col("voter_id").cast("string").alias("imprinted"), F.lit("1").alias("counting_group"), "style", F.lit("").alias("ballot_type"), cells.alias("cells"), F.lit(len(HEADER) + len(of.columns)).alias("n_fields"))
