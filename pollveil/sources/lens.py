"""Long vote records derived from the star schema: an order is a ballot, a line number a contest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.sources import longform


def _contest(fold: int | None) -> Column:
    number = F.col("l_linenumber") if fold is None else F.least(F.col("l_linenumber"), F.lit(fold))
    return F.concat(F.lit("C"), number.cast("string"))


def _is_vote() -> Column:
    return (F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "N")


def long_votes(spark: SparkSession, sf_dir: str, fold: int | None = None) -> DataFrame:
    """fold: line numbers from there on are one contest, so that ballots have fewer contests and fewer styles. No line is
    left out."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    orders = read("orders").select("o_orderkey", "o_custkey")
    customers = read("customer").select("c_custkey", "c_nationkey")
    joined = lines.join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("l_orderkey").alias("voter_id"), _contest(fold).alias("contest"), F.col("l_returnflag").alias("candidate"), _is_vote().alias("isVote"), F.col("c_nationkey").alias("precinctPortionId"))


def votes_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """long_votes whose precinct is that of each line's supplier, so that a voter's votes name several, with places."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", longform.file_place().alias(longform.PLACE))
    joined = lines.join(read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("l_orderkey").alias("voter_id"), _contest(None).alias("contest"), F.col("l_returnflag").alias("candidate"), _is_vote().alias("isVote"), F.col("s_nationkey").alias("precinctPortionId"), longform.PLACE)


def ballot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """imprinted, ballot_type: a ballot type for each order."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("imprinted"), F.col("o_orderpriority").alias("ballot_type"))
