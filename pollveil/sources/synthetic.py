"""The small test election: 21 ballots of three styles over two contests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.plans.model import Layout

LAYOUT = Layout.of([("A", "A0"), ("A", "A1"), ("B", "B0"), ("B", "B1")])


def synthetic_case(spark: SparkSession) -> DataFrame:
    """Ballot 1 is 1R1 (A only), 2 to 11 are 2S2 (A and B), 12 to 21 are 1S3 (B only). In each block of ten the first
    six vote the first choice of their last contest's block as the closed form below says."""
    n, text = F.col("id"), F.col("id").cast("string")
    place = F.when(n <= 11, n - 2).otherwise(n - 12)  # within the block of ten
    bit = lambda c: c.cast("int").cast("string")
    a0 = F.when(n == 1, "1").when(n <= 11, bit(place < 6)).otherwise("")
    a1 = F.when(n == 1, "0").when(n <= 11, bit(place >= 6)).otherwise("")
    b0 = F.when(n == 1, "").when(n <= 11, bit(place < 5)).otherwise(bit(place < 6))
    b1 = F.when(n == 1, "").when(n <= 11, bit(place >= 5)).otherwise(bit(place >= 6))
    style = F.when(n == 1, "1R1").when(n <= 11, "2S2").otherwise("1S3")
    return spark.range(1, 22).select(
        n.alias("ord"), text.alias("cvr_number"), F.lit("1").alias("tabulator"), F.lit("1").alias("batch"), text.alias("record"), F.concat(F.lit("1-1-"), text).alias("imprinted"),
        F.lit("cg").alias("counting_group"), style.alias("style"), F.lit("").alias("ballot_type"), F.array(a0, a1, b0, b1).alias("cells"), F.lit(12).alias("n_fields"),
    )
