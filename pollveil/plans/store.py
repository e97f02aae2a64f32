"""Cutting lineage and numbering rows at any size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it has none: that of spark.checkpoint.dir; in local mode a temporary one;
    on a cluster there is no folder that executors share, so that this is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, materialised in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *keys: str, to: str = "ord") -> DataFrame:
    """df with a gapless number from 1 in the order of its (unique) keys, without passing all rows through one task:
    rows are dealt by ranges and sorted, and each partition adds the counts of those before it."""
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = sorted(dealt.groupBy("__part").count().collect())  # a row for each partition
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __before long")
    return dealt.join(F.broadcast(offsets), "__part").withColumn(to, F.col("__at") + F.col("__before") + 1).drop("__part", "__at", "__before")
