"""Aggregates of a few rare ballots, which borrow from the largest style, and of none, against the SQL."""

from __future__ import annotations

import duckdb
import pytest

from pollveil.plans import oracle, queries
from tests.test_oracles import plain

#: Contests (line numbers) of each ballot: with three rare ballots seven are borrowed.
STYLES = {"few": [(1, 2)] * 30 + [(2, 3)] * 3 + [(1,)] * 12, "none": [(1, 2)] * 30 + [(1,)] * 12, "seven": [(1, 2)] * 30 + [(6, 7)] * 3 + [(1,)] * 12}


@pytest.fixture(scope="module", params=["few", "none"])
def tables(request, tmp_path_factory):
    return made(request.param, tmp_path_factory)


@pytest.fixture(scope="module")
def seven(tmp_path_factory):
    return made("seven", tmp_path_factory)


def made(kind, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp(kind))
    lines = [(order, number, "RA"[(order + number) % 3 == 0]) for order, own in enumerate(STYLES[kind], 1) for number in own]
    con = duckdb.connect()
    con.execute(f"COPY (SELECT o AS l_orderkey, n AS l_linenumber, f AS l_returnflag, 'F' AS l_linestatus FROM (VALUES {','.join(map(str, lines))}) t(o, n, f)) TO '{folder}/lineitem.parquet'")
    con.execute(f"COPY (SELECT CAST(i AS INTEGER) AS o_orderkey, CAST(i % 4 AS INTEGER) AS o_custkey, '1-URGENT' AS o_orderpriority FROM range(1, 60) t(i)) TO '{folder}/orders.parquet'")
    con.execute(f"COPY (SELECT CAST(i AS INTEGER) AS c_custkey, CAST(i AS INTEGER) AS c_nationkey FROM range(4) t(i)) TO '{folder}/customer.parquet'")
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, con


def equals_sql(spark, tables, name):
    folder, con = tables
    got = queries.queries()[name](spark, folder)
    cursor = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    found = key(got.select(names).collect())
    assert found == key(cursor.fetchall())
    return found


def test_aggregate_votes(spark, tables):
    equals_sql(spark, tables, "aggregate_votes")


def test_aggregate_row_header(spark, tables):
    equals_sql(spark, tables, "aggregate_row_header")


@pytest.mark.parametrize("name", ["aggregate_style_probabilities", "probability_sheet"])
def test_aggregate_style_probabilities(spark, tables, name):
    equals_sql(spark, tables, name)


@pytest.mark.parametrize("name", ["tally_temp_semantics_all", "contest_needs_all", "near_unanimous_spec_all"])
def test_whole_queries_keep_seven_contests_and_the_minimum(spark, seven, name):
    assert oracle.WHOLE[name][:2] == (None, 10)
    assert {r[0] for r in equals_sql(spark, seven, name)} >= {"C6", "C7"}
