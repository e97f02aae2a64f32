"""The corpus pipeline: language identification, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All stand null, empty, blank and very
long texts, null ids, ties, repeated rows, further columns of whatever name, and an empty table, which gives no rows; what
these give is said with each stage. `run` writes each stage's result as
Parquet into the shared checkpoint folder and reads it again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pollveil.llm.common import bound_batches, stash, table
from pollveil.llm.decontaminate import keep_clean
from pollveil.llm.langid import keep_identified
from pollveil.llm.packing import digests, pack
from pollveil.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null and empty texts among them, and those between two languages. Texts count
    as a whole; repeated rows are all kept or all dropped; columns stay as they are."""
    bound_batches(spark)
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates: five words, similarity 0.8 or more. Equal
    texts are near-duplicates, repeated rows too, of which one stays; columns stay as they are."""
    bound_batches(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of the benchmark occurs. Null and empty texts hold none, null and blank items occur
    nowhere; repeated rows are all kept or all dropped; columns stay as they are."""
    bound_batches(spark)
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of the sources' shares: a row for each piece of a document. Null and empty texts are
    the end token alone; a null source is a source of its own; repeated rows are packed each."""
    bound_batches(spark)
    return digests(pack(docs))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL cannot express the stages; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
