"""Column functions on vote cells. All run inside Spark's own expressions; only `format_probability` needs Python,
because no built-in formatter rounds the exact binary value the way the published sheets do."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pollveil.plans.model import AGGREGATE_PREFIX, HEADER, Layout

#: What sums of cells take as a number: digits with at most one point and a leading minus; no exponent, plus or nan.
NUMBER = r"^-?(\d+\.?\d*|\.\d+)$"


def strip(c: Column) -> Column:
    """Without white space of any kind around; null is empty. The usual cells need no regular expression."""
    return F.when(c.isin("", "0", "1"), c).when(c.isNull(), "").otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def is_present(c: Column) -> Column:
    return strip(c) != ""


def signature(cells: Column) -> Column:
    """A 1 for each vote column that is filled, over the row's own length."""
    return F.array_join(F.transform(cells, lambda c: F.when(is_present(c), "1").otherwise("0")), "")


def legacy_signature(style: Column, cells: Column) -> Column:
    """The signature behind the first three characters of the style."""
    return F.concat(F.substring(F.coalesce(style, F.lit("")), 1, 3), signature(cells))


def any_present(cells: Column, own: list[int]) -> Column:
    """Whether any of the columns is filled; written out, since Spark compiles no lambdas."""
    return reduce(or_, (F.coalesce(is_present(F.get(cells, F.lit(i))), F.lit(False)) for i in own))


def contest_pattern(cells: Column, layout: Layout) -> Column:
    """A 1 for each contest, by name, of which any column is filled. Columns past the row's end are not."""
    of = [F.array_max(F.transform(F.lit(own), lambda i: is_present(F.get(cells, i)).cast("int"))).cast("string") for _, own in layout.sorted_contests]
    return F.concat(*of) if of else F.lit("")


def contests_on(cells: Column, layout: Layout, wanted: list[str] | None = None) -> Column:
    """Names of the wanted contests that are on the ballot, in the order given."""
    own = layout.contests
    return F.array_compact(F.array(*(F.when(F.exists(F.lit(own[c]), lambda i: is_present(F.get(cells, i))), F.lit(c)) for c in (wanted if wanted is not None else own) if c in own)))


def descriptive_name(pattern: Column, n: Column, number: Column, min_ballots: int) -> Column:
    """Number of contests, R for a rare or S for a safe style, and the style's number."""
    return F.concat(F.length(F.replace(pattern, F.lit("0"), F.lit(""))).cast("string"), F.when(n < min_ballots, "R").otherwise("S"), number.cast("string"))


def is_aggregate(cvr_number: Column) -> Column:
    return strip(cvr_number).startswith(AGGREGATE_PREFIX)


def summand(cell: Column) -> Column:
    """The cell as a number to add up; null for what is none."""
    own = strip(cell)
    return F.when(own.rlike(NUMBER), F.expr("double(1)") * own.try_cast("double"))


def vote_count(cell: Column, aggregate: Column) -> Column:
    """Votes that a cell stands for: an aggregate's truncated number; a ballot's 1 only if it is exactly 1."""
    own = strip(cell)
    return F.when(aggregate, F.coalesce(own.try_cast("double").try_cast("bigint"), F.lit(0))).otherwise((own == "1").cast("long"))


def balance_count(cell: Column) -> Column:
    """What a cell adds to the counts that balancing goes by: nothing if blank or 0, its truncated number, else 1."""
    own = strip(cell)
    return F.when((own == "") | (own == "0"), F.lit(0)).otherwise(F.coalesce(own.try_cast("double").try_cast("bigint"), F.lit(1))).cast("long")


def is_one(cell: Column) -> Column:
    """Whether a cell reads as the whole number 1. Casts that fail are slow, so that none is tried here."""
    own = strip(cell)
    return F.when(own.isin("", "0", "1"), own == "1").otherwise(own.rlike(r"^\+?0*1$"))


def typed_cell(cell: Column) -> Column:
    """number (null for blanks and texts) and text (as it was, where it is no whole number)."""
    own = strip(cell)
    number = F.when(own.rlike(r"^[+-]?\d+$"), own.try_cast("bigint"))
    return F.struct(number.alias("number"), F.when(number.isNull(), F.coalesce(cell, F.lit(""))).alias("text"))


def style_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the columns filled in two signatures, without their first three characters."""
    one, two = (F.when(F.length(c) > 3, F.substr(c, F.lit(4))).otherwise("") for c in (a, b))
    ones = lambda c: F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substr(c, i, F.lit(1)) == "1")
    both, either = F.size(F.array_intersect(ones(one), ones(two))), F.size(F.array_union(ones(one), ones(two)))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def sort_key(cvr_number: Column) -> dict[str, Column]:
    """Classes of the output's order: numbers, other texts, aggregates by the number behind the first hyphen, other
    aggregates. Numbers of more than 38 digits follow the others of their class by length and digits."""
    own, digits = strip(cvr_number), r"^[+-]?\d+(_\d+)*$"
    aggregate = is_aggregate(cvr_number)
    tail = strip(F.get(F.split(own, "-"), F.lit(1)))
    kind = F.when(aggregate & tail.rlike(digits), 2).when(aggregate, 3).when(own.rlike(digits), 0).otherwise(1)
    text = F.when(kind == 2, tail).when(kind == 0, own)
    number = F.replace(text, F.lit("_"), F.lit("")).try_cast("decimal(38,0)")
    plain = F.regexp_replace(F.replace(text, F.lit("_"), F.lit("")), r"^([+-]?)0*", "")
    return {"sort_class": kind, "sort_number": number, "sort_digits": F.when(number.isNull() & kind.isin(0, 2), F.length(plain)), "sort_text": F.when(number.isNull(), F.coalesce(plain, own))}


def probability_text(p: float | None) -> str:
    """0.0000, 1.000 from one up, else four decimals in six characters; null stays empty."""
    return "" if pd.isna(p) else "0.0000" if p == 0 else "1.000" if p >= 1 else f"{p:.4f}"[:6]


@F.pandas_udf(StringType())
def format_probability(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """probability_text of each value."""
    for v in values:
        yield pd.Series([probability_text(p) for p in v])


def blanked_header(identifier: str) -> dict[str, Column]:
    """Header fields of an aggregate: its id, blanks, and AGGREGATED as ballot type."""
    return {c: F.lit(identifier if c == "cvr_number" else "AGGREGATED" if c == "ballot_type" else "") for c in HEADER}
