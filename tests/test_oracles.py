from __future__ import annotations

import decimal

import duckdb
import pytest

from pollveil.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = ["lineitem", "orders", "customer", "supplier"]


def plain(x):
    if isinstance(x, (float, decimal.Decimal)) and not isinstance(x, bool):
        return round(float(x), 9)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    cursor = duck.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert key(got.select(names).collect()) == key(cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 85
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize(("k", "styles", "ballots"), [(3, 31, 45), (10, 58, 163), (20, 72, 364)])
def test_rare_tail_of_the_lens(spark, k, styles, ballots):
    from pollveil.operators import styles as S

    case = queries.Case(spark, SF, None, k)
    own = S.rare_common(case.styled, k).where("is_rare").agg({"sig": "count", "n": "sum"}).first()
    assert sorted(own) == sorted([styles, ballots])


def test_release_does_not_depend_on_partitions(spark):
    from pollveil.operators import release as R
    from pollveil.plans.model import Config

    case = queries.Case(spark, SF, 4, 5)
    one = R.anonymize(case.ballots, case.layout, Config(min_ballots=5)).output.collect()
    two = R.anonymize(case.ballots.repartition(3), case.layout, Config(min_ballots=5)).output.collect()
    assert one == two
