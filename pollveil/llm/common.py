"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A-Z and a-z, for the ASCII-only lower casing that the contracts ask for.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch at most, where this module materialises.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null doc_id has fold null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it has none: that of spark.checkpoint.dir; in local mode, as in tests, a
    temporary one; on a cluster there is no folder that executors share, so that this is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session hold BATCH_ROWS rows at most; a smaller setting stays. For programs that
    hand out DataFrames of whole texts whose action is not theirs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(name))
    spark.conf.set(name, str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Arrow batches to and from Python hold BATCH_ROWS rows at most: rows are whole texts or sets of their hashes,
    so that the session's number of rows could be many times what a task may hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that no lost executor makes earlier stages run again."""
    checkpoint_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def grown_partitions(df: DataFrame, rows: int, per_partition: int) -> int:
    """How many partitions keep about per_partition rows in each; never fewer than the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // per_partition))


def stash(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: as cut(), but narrow reads skip the wide columns.

    The table goes when the session's JVM ends."""
    sc = df.sparkSession.sparkContext
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, value: str, *keys: str, to: str) -> DataFrame:
    """df with the sum of `value` over all rows before each in the order of the keys. Rows are dealt by ranges and sorted;
    each partition adds the sums of those before it, so that no task sees all rows of a key."""
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    names, at = df.columns, df.columns.index(value)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(at).to_numpy(zero_copy_only=False)
            sums = total + np.cumsum(own) - own
            total += int(own.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(sums, pa.int64())], [*names, "__part", to])

    own = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    summed = cut(dealt.mapInArrow(add, f"{own}, __part int, `{to}` long"))
    sizes = sorted(tuple(r) for r in summed.groupBy("__part").agg(F.sum(value)).collect())  # a row for each partition
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])])[: len(sizes)].tolist()
    starts = df.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before, strict=True)], "__part int, __before long")
    return summed.join(F.broadcast(starts), "__part").withColumn(to, F.col(to) + F.col("__before")).drop("__part", "__before")
