from __future__ import annotations

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """documents from (doc_id, text, lang, source), with further columns whose names clash with what operators make."""
    own = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCUMENTS)
    return own.selectExpr("*", "'x' as fp", "'x' as root", "1 as n", "'x' as key", "'x' as component_id", "'x' as language", "'x' as score", "'x' as words", "'x' as ids", "'x' as queue", "'x' as codec", "'x' as held_out")


LONG = "alpha beta gamma delta " * 20_000
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n ", None, None),
    (4, "one", "en", "a"),
    (5, "one two", "de", "b"),
    (6, LONG, "en", "a"),
    (6, LONG, "en", "a"),
    (7, "The quick brown fox jumps over the lazy dog", "en", None),
    (7, "The quick brown fox jumps over the lazy dog", "en", None),
    (8, "the QUICK brown fox jumps over the lazy dog", "en", "b"),
    (None, "Ünïcode ßtraße 漢字   🙂 text", "de", "b"),
    (None, None, None, None),
]
