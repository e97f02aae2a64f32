"""HTML extraction and the pipeline."""

from __future__ import annotations

import html
import re
import zlib

import pytest

import corpus_pipeline
from pollveil.llm import decontaminate, htmltext, langid, queries
from tests.llm.helpers import EDGES, SF, documents
from tests.llm.test_documents import check_packing
from tests.llm.test_shingles import plain_kept


def test_articles_of_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.QUERIES["op5_html_main_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        own = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in own if b) and r.n_chars == len(r.text)


def test_the_tree_learned_its_table():
    right = total = 0
    for page, labels in htmltext.labelled_pages():
        found = htmltext.blocks(page)
        got = [htmltext.accepts(htmltext.trained(), row) for row in htmltext.features(found).tolist()]
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right >= 0.99 * total


PARAGRAPH = "A paragraph of the article, long enough that nobody would take it for a menu, with a number of words in it. " * 2


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<p>", ""),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style>", ""),
        ("<nav><ul><li><a href='/'>a</a></li></ul></nav><article><h1>T &amp; U</h1><p>One&nbsp;two<br>three <b>f</b>our</p></article><footer>no</footer>", "T & U\nOne two three four"),
        ("<article><p>Kept.</p><form>no <input></form><aside>no</aside><div class='share-buttons'>no</div><p>Kept too.</p></article><section id='comments'><p>no</p></section>", "Kept.\nKept too."),
        (f"<body><div class='header'>no</div><div class='content'><p>{PARAGRAPH}</p><p>short</p></div><div class='sidebar'><p>{PARAGRAPH}</p></div></body>", PARAGRAPH.strip() + "\nshort"),
        ("<article><p>cut off & never clo", "cut off & never clo"),
        ("<article><!-- <p>no</p> --><p title='a > b'>yes</p><div hidden>no</div></article>", "yes"),
        ("<html><body class='has-sidebar'><main><p>yes</p></main></body></html>", "yes"),
    ],
)
def test_pages(page, want):
    assert htmltext.main_text(page) == want


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<article><p>x</p></article>"), (3, "u", "<article>" + "<p>many words here</p>" * 20_000)], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    rows = htmltext.extract(pages).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in rows[:4]] == [(1, "", 0), (2, "", 0), (2, "", 0), (None, "x", 1)] and rows[4].n_chars == 20_000 * 16 - 1
    assert htmltext.extract(pages.where("false")).count() == 0


def test_stages_against_the_plain_ones(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, SF)
        before = docs.collect()
        if name == "packing":
            check_packing(result.collect(), docs)
            break
        assert result.columns == docs.columns
        result.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        got = sorted(r.doc_id for r in docs.collect())
        if name == "language_id":
            model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id is not null").where("pmod(crc32(cast(doc_id as string)), 5) <> 0"))
            names, _, close = model.predict([r.text for r in before])
            want = [r.doc_id for r, n, c in zip(before, names, close, strict=True) if n != "und" and not c]
        elif name == "near_dedup":
            want = plain_kept(before)  # all pairs of sets of five words
        else:
            want = [r.doc_id for r in before if not any(i in decontaminate.normal(r.text) for i in items)]
        assert got == sorted(want)


def test_run_and_edges(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = documents(spark, EDGES)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert zlib.crc32(b"5") % 5 in range(5)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "packing"]
