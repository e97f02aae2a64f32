"""Line deduplication, held against plain Python and SQL."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pollveil.llm import linededup, queries
from tests.llm.helpers import EDGES, SF, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def plain(texts, min_docs=10, min_chars=1):
    lines = [(t or "").split("\n") for t in texts]
    n = Counter(k for own in lines for k in {key(x) for x in own} if len(k) >= min_chars)
    out = []
    for own in lines:
        left = [x for x in own if n[key(x)] < min_docs]
        out.append((len(own), len(own) - len(left), "\n".join(left)))
    return out


def check(docs, **how):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows], **{k: v for k, v in how.items() if k.startswith("min")}), strict=True)]
    got = [tuple(r) for r in linededup.drop_frequent(docs, **how).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def random_rows(seed, n=300):
    rng = np.random.default_rng(seed)
    pool = ["Menu", " menu\t", "MENU\r", "", "  ", "Ünter", "ünter", " x", "x", "common line", *(f"line {i}" for i in range(60))]
    weight = 1 / (1 + np.arange(len(pool)))
    return [(int(rng.integers(n)) if i % 7 else None, "\n".join(rng.choice(pool, rng.integers(0, 9), p=weight / weight.sum())) if i % 11 else None, None, None) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize(("keys", "places", "batches"), [(200_000, 1_000_000, 4), (3, 0, 1), (3, 10, 9)])
def test_equals_plain_python_however_keys_are_joined(spark, seed, keys, places, batches):
    got = check(documents(spark, random_rows(seed)), min_docs=4, broadcast_keys=keys, broadcast_places=places, batches=batches)
    assert sum(r[2] for r in got) > 100


def test_edges(spark):
    own = documents(spark, EDGES)
    check(own)
    got = check(own, min_docs=2)
    assert sum(r[2] for r in got) == 5  # both copies of the long text, and three of the fox
    check(own.unionAll(own), min_docs=2, min_chars=0)
    nothing = linededup.drop_frequent(own.where("false"))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "n_lines", "n_dropped", "kept"]


def test_a_long_document_of_frequent_and_other_lines(spark):
    long = "\n".join("again" if i % 2 else f"line {i}" for i in range(40_000))
    got = check(documents(spark, [(i, "again", None, None) for i in range(3)] + [(9, long, None, None)]), min_docs=4)
    assert ("9", 20_000) in {(str(r[0]), r[2]) for r in got}


def test_runs_are_levelled_and_merge_joined(spark):
    counts = lambda lo, hi, n: spark.range(lo, hi).select((F.col("id") * 7919).alias("h1"), (-F.col("id")).alias("h2"), F.lit(n).cast("long").alias("n"))
    runs = linededup.LineRuns(spark, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")), fanout=3)
    sizes = []
    for b in range(10):
        runs.add(counts(100 * b, 100 * b + 150, b + 1), enough=3)
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [2], [0, 1], [1, 1], [2, 1], [0, 2], [1, 2], [2, 2], [0, 0, 1], [1, 0, 1]]
    got = {-r.h2: r.n for r in runs.counts().collect()}
    want = {}
    for b in range(10):
        for i in range(100 * b, 100 * b + 150):
            want[i] = want.get(i, 0) + (b + 1 if want.get(i, 0) < 3 else 0)
    assert got == want
    new = runs.unseen(counts(900, 1100, 1))
    assert sorted(-r.h2 for r in new.collect()) == list(range(1050, 1100))
    plan = runs.unseen(counts(900, 1100, 1).groupBy("h1", "h2").agg(F.sum("n").alias("n")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1, plan  # the batch's own
    old = [n for level in runs.levels for n in level]
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in old)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op11_line_dedup"])
    got = queries.QUERIES["op11_line_dedup"](spark, SF).select([d[0] for d in cursor.description]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(cursor.fetchall(), key=repr)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    want = {i: (n, d, hashlib.sha256(k.encode()).hexdigest()) for i, (n, d, k) in zip(ids, plain([texts[i] for i in ids]), strict=True)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == want and sum(r.n_dropped for r in got) > 0
