"""Fill-in-the-middle rewriting, held against plain Python."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

from pollveil.llm import infill, queries
from tests.llm.helpers import EDGES, SF, documents

ODD = [
    (21, "a\x00b\tc\r\nd", None, None),
    (22, "has <P> inside", None, None),
    (23, "nearly < P> <S <M and >", None, None),
    (24, "<<<>>>S>M>P>", None, None),
    (25, "ſKÅ🙂é words 12345", None, None),
    (-26, "negative id", None, None),
    (27, "x", None, None),
]


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = ["".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n))]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = parts
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, form, len(prefix), len(middle), out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("step", [1, infill.STEP_BYTES])
def test_rewriting_equals_plain_python(spark, monkeypatch, step):
    monkeypatch.setattr(infill, "STEP_BYTES", step)
    own = documents(spark, EDGES + ODD)
    texts = [(r.doc_id, r.text) for r in own.collect()]
    got = [tuple(r) for r in infill.fill_in_middle(own).collect()]
    assert sorted(got, key=repr) == sorted([(i, *plain(i, t)) for i, t in texts], key=repr)
    digests = [tuple(r) for r in infill.fill_in_middle(own, digests=True).collect()]
    want = [(i, *(p := plain(i, t))[:4], sha(p[4]), sha(t or "")) for i, t in texts]
    assert sorted(digests, key=repr) == sorted(want, key=repr)


def test_shares_are_parameters_and_empty_tables_stay_empty(spark):
    own = documents(spark, EDGES)
    assert {r.form for r in infill.fill_in_middle(own, fim=0).collect()} == {"plain"}
    assert {r.form for r in infill.fill_in_middle(own.where("length(text) > 0"), fim=100, spm=100).collect()} == {"spm"}
    nothing = infill.fill_in_middle(own.where("false"))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_query_equals_sql_and_plain_python(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op13_fill_in_middle"])
    got = queries.QUERIES["op13_fill_in_middle"](spark, SF).select([d[0] for d in cursor.description]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(cursor.fetchall(), key=repr)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (*(p := plain(r.doc_id, texts[r.doc_id]))[:4], sha(p[4])) and r.restored_sha256 == sha(texts[r.doc_id] or "") for r in got)
