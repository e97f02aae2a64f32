"""Exploration of signatures: frequencies, column vectors, co-occurrence, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollveil.functions import cells as C
from pollveil.plans.store import cut


def style_frequency(ballots: DataFrame) -> DataFrame:
    """legacy_sig, n."""
    return ballots.groupBy(C.legacy_signature(F.col("style"), F.col("cells")).alias("legacy_sig")).agg(F.count("*").alias("n"))


def _bits(signatures: DataFrame) -> DataFrame:
    return signatures.select("sig", F.posexplode(F.split("sig", "")).alias("pos", "bit")).where("bit <> ''")


def column_vectors(signatures: DataFrame) -> DataFrame:
    """vector, n: what each vote column reads over the distinct signatures in order, and how many columns read so."""
    own = _bits(signatures.select("sig").distinct()).groupBy("pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sig", "bit"))), lambda x: x.bit), "").alias("vector"))  # as long as there are styles
    return own.groupBy("vector").agg(F.count("*").alias("n"))


def column_groups(signatures: DataFrame) -> DataFrame:
    """first_col, n, ones, styles: columns that read alike over the distinct signatures (named by the first of them), how
    many they are, in how many signatures they are filled and how many reach so far.

    A column is summed up by the exclusive or of hashes of the signatures that fill it, and of those that reach it: partial
    results merge in any order, and no row is longer than a ballot. Columns of one sum are then compared with the first of
    them signature by signature; one that differs ends in an error."""
    own = signatures.select("sig").distinct().withColumn("bits", F.filter(F.split("sig", ""), lambda b: b != ""))
    seeds = [F.xxhash64("sig"), F.xxhash64(F.lit(1), F.col("sig"))]
    bits = own.select(*(s.alias(f"h{k}") for k, s in enumerate(seeds)), F.posexplode("bits").alias("pos", "bit"))
    filled = F.col("bit") == "1"
    sums = {f"x{k}": F.bit_xor(F.when(filled, F.col(f"h{k}"))) for k in range(2)} | {f"y{k}": F.bit_xor(f"h{k}") for k in range(2)}
    columns = cut(bits.groupBy("pos").agg(F.count_if(filled).alias("ones"), F.count("*").alias("styles"), *(F.coalesce(s, F.lit(0)).alias(n) for n, s in sums.items())))
    groups = columns.groupBy(*sums, "ones", "styles").agg(F.min("pos").alias("first_col"), F.count("*").alias("n"))
    of = columns.join(groups, [*sums, "ones", "styles"]).select("pos", "first_col")
    pairs = own.select("bits", F.posexplode("bits").alias("pos", "bit")).join(F.broadcast(of), "pos")  # as many rows as a ballot has columns
    wrong = pairs.groupBy("first_col").agg(F.count_if(~F.get("bits", F.col("first_col")).eqNullSafe(F.col("bit"))).alias("wrong"))
    checked = F.when(F.col("wrong") == 0, F.col("n")).otherwise(F.raise_error(F.lit("columns of one hash differ")).cast("long"))
    return groups.join(wrong, "first_col").select("first_col", checked.alias("n"), "ones", "styles")


def _words(signatures: DataFrame) -> DataFrame:
    """block, columns (pos, ones, there): 64 signatures a block, of which a column fills some and reaches some, as bits."""
    numbered = cut(signatures.select("sig").distinct().withColumn("id", F.monotonically_increasing_id()))  # other numbers after a lost task would mix blocks
    own = numbered.select(F.floor(F.col("id") / 64).alias("block"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 64).cast("int")).alias("word"), F.posexplode(F.filter(F.split("sig", ""), lambda b: b != "")).alias("pos", "bit"))
    words = own.groupBy("block", "pos").agg(F.bit_or(F.when(F.col("bit") == "1", F.col("word")).otherwise(0)).alias("ones"), F.bit_or("word").alias("there"))
    return words.groupBy("block").agg(F.collect_list(F.struct("pos", "ones", "there")).alias("columns"))  # as wide as a ballot


def column_cooccurrence(signatures: DataFrame) -> DataFrame:
    """i, j, pair, n over the distinct signatures. Columns are sliced into words of 64 signatures, so that a pair of columns
    costs a row for 64 of them: 11 by the bits that both have, the others by subtraction."""
    one = _words(signatures).select("columns", F.explode("columns").alias("a"))
    two = one.select("a", F.explode("columns").alias("b"))
    both = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.col(y)))
    counts = {"c11": both("a.ones", "b.ones"), "one": both("a.ones", "b.there"), "other": both("a.there", "b.ones"), "every": both("a.there", "b.there")}
    found = two.groupBy(F.col("a.pos").alias("i"), F.col("b.pos").alias("j")).agg(*(F.sum(c).alias(n) for n, c in counts.items()))
    c = F.col
    each = {"11": c("c11"), "10": c("one") - c("c11"), "01": c("other") - c("c11"), "00": c("every") - c("one") - c("other") + c("c11")}
    return found.select("i", "j", F.inline(F.array(*(F.struct(F.lit(p).alias("pair"), n.alias("n")) for p, n in each.items())))).where("n > 0")


def similarity_to(signatures: DataFrame, to: str | None) -> DataFrame:
    """sig, similarity to one signature; no rows where there is none to compare with."""
    if to is None:
        signatures, to = signatures.where("false"), ""
    return signatures.select("sig", C.style_similarity(F.col("sig"), F.lit(to)).alias("similarity"))
