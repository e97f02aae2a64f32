"""The registered queries: each applies one operator to ballots that the star schema is read as."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.functions import cells as C
from pollveil.operators import balance as B
from pollveil.operators import entropy as E
from pollveil.operators import explore as X
from pollveil.operators import inference as I
from pollveil.operators import release as R
from pollveil.operators import styles as S
from pollveil.operators import suppress as U
from pollveil.operators import tally as T
from pollveil.plans.model import Config
from pollveil.plans.oracle import FOLD, SELECTS, WHOLE, WHOLE_SUFFIX
from pollveil.plans.store import cut
from pollveil.sources import lens, longform
from pollveil.sources.synthetic import synthetic_case


class Case:
    """The ballots of the lens, lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str, fold: int | None, k: int):
        self.spark, self.sf_dir, self.k = spark, sf_dir, k
        self.long = lens.long_votes(spark, sf_dir, fold)
        self._found: dict = {}

    def _once(self, name: str, make: Callable):
        if name not in self._found:
            self._found[name] = make()
        return self._found[name]

    @property
    def layout(self):
        return self._once("layout", lambda: longform.layout(self.long))

    @property
    def ballots(self) -> DataFrame:
        return self._once("ballots", lambda: longform.ballots(self.long, self.layout))

    @property
    def unordered(self) -> DataFrame:
        """The ballots without numbers, for what no order decides."""
        return self._once("unordered", lambda: longform.ballots(self.long, self.layout, in_order=False))

    @property
    def styled(self) -> DataFrame:
        return self._once("styled", lambda: cut(S.with_style(self.ballots, self.layout)))

    @property
    def unordered_styled(self) -> DataFrame:
        return self._once("unordered_styled", lambda: cut(S.with_style(self.unordered, self.layout)))

    @property
    def unordered_rare(self) -> DataFrame:
        return S.with_rarity(self.unordered_styled, self.k).where("is_rare").select(self.unordered_styled.columns)

    @property
    def rare(self) -> DataFrame:
        return S.with_rarity(self.styled, self.k).where("is_rare").select(self.styled.columns)

    @property
    def borrowed(self) -> DataFrame:
        return self._once("borrowed", lambda: B.borrow_for_minimum(self.styled, self.k))

    @property
    def members(self) -> DataFrame:
        return self.rare.unionByName(self.borrowed)

    def aggregated(self, in_order: bool = False) -> DataFrame:
        """What goes into the aggregate, for sums: the members. Without in_order ballots are numbered only where some are
        borrowed, since order decides which."""
        found = B.shortage(self.styled if in_order else self.unordered_styled, self.k)
        if 0 < found.rare < self.k and found.largest is not None:
            return self.members
        return self.rare if in_order else self.unordered_rare

    @property
    def pool(self) -> DataFrame:
        return B.pool_after(self.styled, self.borrowed, self.k)

    @property
    def released(self) -> DataFrame:
        return R.redact(R.without_aggregated(self.ballots, self.members))

    @property
    def output(self) -> DataFrame:
        return self.released.unionByName(R.aggregate_row(self.members))

    @property
    def needs(self) -> dict[str, int]:
        return {r.contest: r.need for r in T.contest_needs(self.members, self.layout, self.k).collect()}

    @property
    def counts(self) -> dict[str, dict[str, int]]:
        return B.as_counts(T.choice_counts(self.members, self.layout))

    def by_signature(self, in_order: bool = True) -> DataFrame:
        """Ballots whose CVR style is their signature, for guesses by style."""
        return (self.styled if in_order else self.unordered_styled).withColumn("style", F.col("sig"))


def _text(c="cells"):
    return F.array_join(c, ",").alias("cells")


def _gains(c: Case) -> DataFrame:
    counts = c.counts
    each = [F.struct(F.lit(name).alias("contest"), B.gain(F.col("cells"), name, c.layout, counts.get(name, {})).alias("gain"), F.exists(F.lit(own), lambda i: C.is_present(F.get("cells", i))).alias("on_it")) for name, own in c.layout.contests.items()]
    return c.ballots.select("ord", F.inline(F.array(*each))).where("on_it").drop("on_it")


def _first_winners(c: Case) -> dict[str, str]:
    return {name: c.layout.columns[own[0]].choice for name, own in c.layout.contests.items()}


def _scores(c: Case) -> DataFrame:
    return B.balancing_scores(c.pool, c.layout, c.needs, c.counts, c.k)


def _guesses(c: Case, of: Callable) -> DataFrame:
    aggregate = R.aggregate_row(c.aggregated(in_order=True)).withColumn("style", F.col("cvr_number"))
    columns = ["style", "contest", "choice", "prob"]
    by_style = I.style_probabilities(c.by_signature(), c.layout, c.k).where("is_common").select(columns).unionByName(I.aggregate_probabilities(aggregate, c.layout, c.k).select(columns))
    common = S.rare_common(c.styled, c.k).where("not is_rare").select(F.col("sig").alias("style"))
    mapping = I.style_mapping(c.by_signature(), common.unionByName(aggregate.select("style")))
    return of(c.by_signature(), c.layout, I.overall_probabilities(c.styled, c.layout), by_style, mapping)


def _wide_sheet(c: Case) -> DataFrame:
    """Every voter's row of the overall sheet; a voter in ten has no contest left."""
    blank = F.expr("transform(cells, x -> '')")
    some = c.ballots.withColumn("cells", F.when(F.col("ord") % 10 == 0, blank).otherwise(F.col("cells")))
    sheet = I.wide_sheet(I.ballot_probabilities(some, c.layout, I.overall_probabilities(some, c.layout)), c.layout)
    names = [f"{v.contest}_{v.choice}" for v in c.layout.columns]
    return sheet.toDF("voter", "style", *names).select("voter", "style", F.concat_ws(",", *(F.col(n) for n in names)).alias("probabilities"))


def _mapping(c: Case) -> DataFrame:
    common = S.with_rarity(c.by_signature(False), c.k).where("not is_rare").select("style")
    return I.style_mapping(c.by_signature(False), common.unionByName(I.marked_style(R.aggregate_row(c.unordered_rare)).select("style")))


def _largest(c: Case) -> str | None:
    found = B.largest_common_style(S.style_groups(c.styled), c.k).first()
    return found.sig if found else None


def _typed(c: Case) -> DataFrame:
    return c.ballots.select(F.col("ord").alias("cvr"), F.posexplode("cells").alias("col_idx", "cell")).select("cvr", "col_idx", C.typed_cell(F.col("cell")).alias("t")).select("cvr", "col_idx", "t.number", "t.text")


APPLY: dict[str, Callable[[Case], DataFrame]] = {
    "parquet_long_filter": lambda c: longform.votes(c.long).select("voter_id", "contest", "candidate", F.col("precinctPortionId").alias("precinct")),
    "column_dictionary": lambda c: c.layout.frame(c.spark),
    "ballot_numbering": lambda c: c.ballots.select(F.col("imprinted").cast("long").alias("voter_id"), F.col("cvr_number").cast("long").alias("cvr_number"), "tabulator", "batch", F.col("record").cast("long").alias("record"), "imprinted", "counting_group", "ballot_type"),
    "ballot_precinct": lambda c: longform.numbered_voters(c.long, c.layout).select("voter_id", "style"),
    "wide_cells": lambda c: c.ballots.select(F.col("ord").alias("cvr"), F.posexplode("cells").alias("col_idx", "cell")),
    "style_signature": lambda c: c.ballots.select(F.col("ord").alias("cvr"), C.signature(F.col("cells")).alias("sig")),
    "contest_pattern": lambda c: c.ballots.select(F.col("ord").alias("cvr"), C.contest_pattern(F.col("cells"), c.layout).alias("pattern")),
    "contests_for_row": lambda c: c.ballots.select(F.col("ord").alias("cvr"), F.array_join(C.contests_on(F.col("cells"), c.layout), ",").alias("contests")),
    "typed_cells": _typed,
    "style_groups": lambda c: S.style_groups(c.styled),
    "cvr_style_counts": lambda c: S.cvr_style_counts(c.unordered),
    "rare_common_split": lambda c: S.rare_common(S.with_style(c.unordered, c.layout), c.k).drop("style_ord"),
    "rare_style_breakdown": lambda c: S.rare_breakdown(c.styled, c.k),
    "descriptive_names": lambda c: S.named_patterns(S.with_style(c.unordered, c.layout), c.k),
    "leakage_cvr_style": lambda c: S.leakage_by_cvr_style(S.with_style(c.unordered, c.layout)),
    "leakage_ballot_type": lambda c: S.leakage_by_ballot_type(S.with_style(c.unordered, c.layout).drop("ballot_type").join(lens.ballot_types(c.spark, c.sf_dir), "imprinted")),
    "cvr_to_descriptive": lambda c: S.cvr_style_names(c.styled, c.k),
    "aggregate_votes": lambda c: T.column_sums(c.aggregated()).select("col_idx", T.printed(F.col("total")).alias("total")),
    "aggregate_row_header": lambda c: R.aggregate_row(c.aggregated()).select("cvr_number", "tabulator", "batch", "record", "imprinted", "counting_group", "style", "ballot_type", F.when(F.size("cells") > 0, _text()).alias("cells")),
    "tally": lambda c: T.tally(c.unordered, c.layout),
    "tally_mixed": lambda c: T.tally(c.output, c.layout),
    "tally_temp_semantics": lambda c: T.group_tally(c.members, c.layout, "compat").drop("first_col"),
    "summary_totals": lambda c: T.summary_totals(c.unordered, c.layout),
    "summary_probabilities": lambda c: T.summary_probabilities(c.unordered_styled, c.layout, S.named_patterns(c.unordered_styled, c.k)),
    "choice_counts": lambda c: T.choice_counts(c.members, c.layout),
    "contest_presence": lambda c: T.contest_presence(c.members, c.layout),
    "contest_needs": lambda c: T.contest_needs(c.members, c.layout, c.k),
    "near_unanimous_spec": lambda c: T.near_unanimous(T.group_tally(c.members, c.layout, "spec")),
    "near_unanimous_compat": lambda c: T.near_unanimous(T.group_tally(c.members, c.layout, "compat")),
    "borrow_for_minimum": lambda c: c.borrowed.select("ord", "sig"),
    "imbalance_gain": _gains,
    "balancing_scores_round1": lambda c: _scores(c).select("ord", F.col("coverage").cast("long"), "gain", "score"),
    "select_balancing_ballot": lambda c: _scores(c).orderBy(F.desc("score"), "style_ord", "ord").limit(1).select("ord", "sig", "score"),
    "find_ballots_with_contest": lambda c: B.find_with_contest(c.pool, c.layout, "C3", 25, c.k).select("ord", "sig"),
    "contrast_scores": lambda c: B.contrast_scores(c.pool, c.layout, _first_winners(c), c.k).select("ord", F.col("score").cast("long"), F.array_join("satisfied", ",").alias("satisfied")),
    "largest_common_style": lambda c: B.largest_common_style(S.style_groups(c.styled), c.k).select("sig", "n"),
    "anti_join_release": lambda c: R.without_aggregated(c.ballots, c.members).select("ord"),
    "redact_release": lambda c: c.released.select("cvr_number", "tabulator", "imprinted", "counting_group", "style", _text()),
    "output_sort_keys": lambda c: R.in_output_order(c.output).select("cvr_number", *(v.alias(n) for n, v in C.sort_key(F.col("cvr_number")).items() if n != "sort_digits")).withColumn("sort_number", F.col("sort_number").cast("long")),
    "verify_tally": lambda c: T.verify(c.ballots, c.output, c.layout),
    "style_mapping": _mapping,
    "style_probabilities": lambda c: I.style_probabilities(c.by_signature(False), c.layout, c.k).select("style", "contest", "choice", "prob", "ballot_count", "is_common"),
    "aggregate_style_probabilities": lambda c: I.aggregate_probabilities(R.aggregate_row(c.aggregated()).withColumn("style", F.col("cvr_number")), c.layout, c.k),
    "overall_probabilities": lambda c: I.overall_probabilities(c.unordered, c.layout),
    "probability_sheet": lambda c: _guesses(c, I.probability_sheet),
    "wide_sheet": _wide_sheet,
    "long_tally_conservation": lambda c: T.conservation(c.long, c.unordered, c.layout),
    "style_voter_order": lambda c: I.in_style_order(c.ballots).select(F.col("ord").alias("cvr"), "style", "voter"),
    "overall_sheet": lambda c: I.probability_sheet(c.ballots, c.layout, I.overall_probabilities(c.ballots, c.layout)),
    "style_similarity": lambda c: X.similarity_to(S.style_groups(c.styled), _largest(c)),
    "style_frequency": lambda c: X.style_frequency(c.unordered),
    "column_vectors": lambda c: X.column_vectors(S.style_groups(S.with_style(c.unordered, c.layout))),
    "column_cooccurrence": lambda c: X.column_cooccurrence(S.style_groups(S.with_style(c.unordered, c.layout))),
    "column_groups": lambda c: X.column_groups(S.style_groups(S.with_style(c.unordered, c.layout))).withColumn("first_col", F.col("first_col").cast("long")),
    "entropy_requirements": lambda c: E.requirements(c.ballots, c.members, c.layout),
    "contest_redaction": lambda c: U.suppress(U.style_table(c.unordered_styled, c.layout), c.k),
    "undervotes_report": lambda c: T.undervotes(c.members, c.layout),
    "exclude_borrowed_pool": lambda c: c.pool.groupBy("sig").agg(F.count("*").alias("n")),
}


def _release(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = Case(spark, sf_dir, None, 10)
        return R.anonymize(c.ballots, c.layout, Config(mode=mode)).output.select("cvr_number", "tabulator", "batch", "record", "imprinted", "counting_group", "style", "ballot_type", _text())

    return run


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Case(spark, sf_dir, FOLD, 10)
    picked = B.cover_contests(c.pool, c.layout, c.needs, c.counts, c.k)
    return spark.createDataFrame([(i, p) for i, p in enumerate(picked)], "pick int, ord long")


def _entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Case(spark, sf_dir, FOLD, 10)
    lacking = {(r.contest, r.choice): r.missing for r in E.requirements(c.ballots, c.members, c.layout).collect()}
    picked, _ = E.pick(c.pool, c.layout, lacking, c.k)
    return spark.createDataFrame([(i, p) for i, p in enumerate(picked)], "pick int, ord long")


def _contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Case(spark, sf_dir, None, 10)
    winners = _first_winners(c)
    picked = B.pick_contrast(B.contrast_scores(c.pool, c.layout, winners, c.k), winners, c.k, "spec")
    return spark.createDataFrame([(i, p) for i, p in enumerate(picked)], "pick int, ord long")


def _first_precinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voters whose votes name several precincts: that of the first, and how many there are."""
    long = lens.votes_by_supplier(spark, sf_dir)
    several = longform.votes(long).groupBy("voter_id").agg(F.count_distinct("precinctPortionId").alias("precincts"))
    return longform.voters(long, longform.layout(long)).select("voter_id", "style").join(several, "voter_id")


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fold, k, _ = (SELECTS | WHOLE)[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = APPLY[name.removesuffix(WHOLE_SUFFIX)](Case(spark, sf_dir, fold, k))
        return found.withColumns({c: F.col(c).cast("long") for c, kind in found.dtypes if kind == "int" and c in ("col_idx", "i", "j")})  # as wide as the SQL's numbers

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _query(name) for name in SELECTS | WHOLE}
    found["synthetic_case"] = lambda spark, sf_dir: synthetic_case(spark).select("ord", "cvr_number", "style", _text())
    return found | {"anonymize_spec": _release("spec"), "anonymize_compat": _release("compat"), "coverage_loop": _coverage, "contrast_loop": _contrast, "entropy_loop": _entropy, "precinct_by_first_vote": _first_precinct}
