"""Every registered query reads whole tables, and releases keep every contest and ballot."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pollveil.plans import oracle, queries
from pollveil.sources import lens
from tests.test_oracles import SF


def test_folded_queries_read_every_line(spark):
    folded = {n for n, (fold, _, _) in oracle.SELECTS.items() if fold is not None}
    assert len(folded) == 15 and {n + "_all" for n in folded} <= set(queries.queries())
    assert not any("WHERE l.l_linenumber" in q for q in oracle.oracle_sql().values())
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for fold in (None, oracle.FOLD):
        assert lens.long_votes(spark, SF, fold).count() == n
    assert lens.votes_by_supplier(spark, SF).where(F.col("precinctPortionId").isNotNull()).count() == n


@pytest.mark.parametrize("mode", ["spec", "compat"])
def test_releases_hold_all_contests(spark, mode):
    case = queries.Case(spark, SF, None, 10)
    rows = queries.queries()[f"anonymize_{mode}"](spark, SF).collect()
    assert {len(r.cells.split(",")) for r in rows} == {len(case.layout.columns)}
    assert set(case.layout.contests) == {f"C{i}" for i in range(1, 8)}
