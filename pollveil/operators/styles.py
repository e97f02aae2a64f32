"""Ballot styles: signatures, patterns, rarity, descriptive names, leakage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pollveil.functions import cells as C
from pollveil.plans.model import Layout


@dataclass
class StyleAnalysis:
    """Lazy tables: names of patterns and of CVR styles, both kinds of leakage, sizes of CVR styles."""

    patterns: DataFrame
    cvr_styles: DataFrame
    shared_patterns: DataFrame
    shared_ballot_types: DataFrame
    sizes: DataFrame


def analyze(ballots: DataFrame, layout: Layout, min_ballots: int = 10) -> StyleAnalysis:
    styled = with_style(ballots, layout)
    return StyleAnalysis(named_patterns(styled, min_ballots), cvr_style_names(styled, min_ballots), leakage_by_cvr_style(styled), leakage_by_ballot_type(styled), cvr_style_counts(ballots))


def with_style(ballots: DataFrame, layout: Layout) -> DataFrame:
    """ballots with sig and pattern, without those that have no vote fields."""
    return ballots.where(F.size("cells") > 0).withColumns({"sig": C.signature(F.col("cells")), "pattern": C.contest_pattern(F.col("cells"), layout)})


def style_groups(styled: DataFrame) -> DataFrame:
    """sig, n, style_ord (the first ballot's place)."""
    return styled.groupBy("sig").agg(F.count("*").alias("n"), F.min("ord").alias("style_ord"))


def cvr_style_counts(ballots: DataFrame) -> DataFrame:
    """style (without white space around), n."""
    return ballots.groupBy(C.strip(F.col("style")).alias("style")).agg(F.count("*").alias("n")).where("style <> ''")


def rare_common(styled: DataFrame, min_ballots: int) -> DataFrame:
    """sig, n, style_ord, is_rare."""
    return style_groups(styled).withColumn("is_rare", F.col("n") < min_ballots)


def with_rarity(styled: DataFrame, min_ballots: int) -> DataFrame:
    """Each ballot with its style's n, style_ord and is_rare. There are few styles next to ballots: Spark broadcasts
    their table while it is small, and shuffles both sides else."""
    return styled.join(rare_common(styled, min_ballots), "sig")


def named_patterns(styled: DataFrame, min_ballots: int) -> DataFrame:
    """pattern, n, style_number, name: styles are numbered in the order of their patterns, a row for each pattern."""
    own = styled.groupBy("pattern").agg(F.count("*").alias("n"))
    own = own.withColumn("style_number", F.row_number().over(Window.orderBy("pattern")).cast("long"))
    return own.withColumn("name", C.descriptive_name(F.col("pattern"), F.col("n"), F.col("style_number"), min_ballots))


def rare_counts(styled: DataFrame, min_ballots: int) -> DataFrame:
    """sig, descriptive_name (by the pattern of the style's first ballot), ballot_count, original_styles (style and n of
    each CVR style that is not blank, sorted)."""
    rare = with_rarity(styled, min_ballots).where("is_rare")
    by_style = rare.groupBy("sig", C.strip(F.col("style")).alias("style")).agg(F.count("*").alias("n"))
    named = F.filter(F.array_sort(F.collect_list(F.struct("style", "n"))), lambda x: x.style != "")  # as many as CVR styles share a signature
    listed = by_style.groupBy("sig").agg(F.sum("n").alias("ballot_count"), named.alias("original_styles"))
    first = rare.groupBy("sig").agg(F.min_by("pattern", "ord").alias("pattern"))
    return listed.join(first, "sig").join(named_patterns(styled, min_ballots).select("pattern", "name"), "pattern", "left").select("sig", F.coalesce("name", "sig").alias("descriptive_name"), "ballot_count", "original_styles")


def rare_breakdown(styled: DataFrame, min_ballots: int) -> DataFrame:
    """sig, name, ballot_count, styles (CVR style:n, sorted)."""
    styles = F.array_join(F.transform("original_styles", lambda x: F.concat(x.style, F.lit(":"), x.n.cast("string"))), ",")
    return rare_counts(styled, min_ballots).select("sig", F.col("descriptive_name").alias("name"), "ballot_count", styles.alias("styles"))


def leakage_by_cvr_style(styled: DataFrame) -> DataFrame:
    """pattern, styles: patterns that more than one CVR style has (blank counts as one)."""
    return styled.groupBy("pattern").agg(F.array_sort(F.collect_set(F.coalesce("style", F.lit("")))).alias("styles")).where("size(styles) > 1").withColumn("styles", F.array_join("styles", "|"))


def leakage_by_ballot_type(styled: DataFrame) -> DataFrame:
    """pattern, types: patterns that more than one non-blank ballot type has."""
    own = styled.where(C.is_present(F.col("ballot_type"))).groupBy("pattern").agg(F.array_sort(F.collect_set("ballot_type")).alias("types"))
    return own.where("size(types) > 1").withColumn("types", F.array_join("types", "|"))


def cvr_style_names(styled: DataFrame, min_ballots: int) -> DataFrame:
    """style, name: a CVR style's descriptive name goes by its first ballot."""
    first = styled.where(C.is_present(F.col("style"))).groupBy("style").agg(F.min_by("pattern", "ord").alias("pattern"))
    return first.join(named_patterns(styled, min_ballots), "pattern").select("style", "name")
