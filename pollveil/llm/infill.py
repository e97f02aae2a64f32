"""Fill-in-the-middle rewriting by DuckDB inside mapInArrow.

A document is cut into units (runs of ASCII letters, and every other code point alone). Two cuts drawn from a hash of the
document's id part the units into prefix, middle and suffix, which go out in suffix-first order between markers; some
documents stay as they are. Each Arrow batch is registered with an in-memory DuckDB of the task and rewritten by one SQL
statement (regexp_extract_all, list_slice, array_to_string, sha256); Arrow comes back, and no row passes through Python.
A statement sees STEP_BYTES of text at most, or one document: units take about 16 bytes each while it runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm.common import table

STEP_BYTES = 4 << 20
# Units, markers and shares (percent) of the contract.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT = 90, 20


def rewriting(source: str, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> str:
    """SQL that gives doc_id, n, form, prefix_chars, middle_chars, output, restored for each row of source (doc_id, key,
    text); restored is rebuilt from output and form alone."""
    h = ", ".join(f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS UBIGINT) AS h{k + 1}" for k in range(4))
    piece = lambda a, b: f"array_to_string(list_slice(units, {a}, {b}), '')"
    return f"""
WITH cut AS (SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS units, sha256('1:' || key) AS digest FROM {source}
), drawn AS (SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, {h} FROM cut
), placed AS (
  SELECT doc_id, text, units, n, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {fim} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parted AS (
  SELECT doc_id, n, form, CASE WHEN form = 'plain' THEN text END AS whole, CASE WHEN form <> 'plain' THEN {piece("1", "a")} END AS prefix,
         CASE WHEN form <> 'plain' THEN {piece("a + 1", "b")} END AS middle, CASE WHEN form <> 'plain' THEN {piece("b + 1", "n")} END AS suffix
  FROM placed
), written AS (
  SELECT doc_id, n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
         CASE form WHEN 'plain' THEN whole WHEN 'psm' THEN concat('{PREFIX}', prefix, '{SUFFIX}', suffix, '{MIDDLE}', middle) ELSE concat('{SUFFIX}', suffix, '{PREFIX}', prefix, '{MIDDLE}', middle) END AS output
  FROM parted
), found AS (
  SELECT *, CASE WHEN form <> 'plain' THEN strpos(output, '{PREFIX}') END AS p, CASE WHEN form <> 'plain' THEN strpos(output, '{SUFFIX}') END AS s, CASE WHEN form <> 'plain' THEN strpos(output, '{MIDDLE}') END AS m FROM written
)
SELECT doc_id, n, form, prefix_chars, middle_chars, output,
       CASE form WHEN 'plain' THEN output
                 WHEN 'psm' THEN concat(substr(output, p + 3, s - p - 3), substr(output, m + 3), substr(output, s + 3, m - s - 3))
                 ELSE concat(substr(output, p + 3, m - p - 3), substr(output, m + 3), substr(output, s + 3, p - s - 3)) END AS restored
FROM found"""


DIGESTED = "SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({})"


def _steps(texts: pa.Array) -> list[tuple[int, int]]:
    """(first row, rows) of stretches of STEP_BYTES at most, or of one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(ends):
        begun = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begun + STEP_BYTES, "right")))
        out.append((at, to - at))
        at = to
    return out


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fim: int = FIM_PERCENT, spm: int = SPM_PERCENT, digests: bool = False) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output, or
    with `digests` output_sha256 and restored_sha256 in its place: a row for each row of docs.

    Null and empty texts are plain and empty; so are, as they stand, texts that hold a marker. Texts are taken whole,
    however long. A null id counts as the empty text; rows of one id are cut by the same draws, and repeated rows give
    equal rows. An empty table gives no rows; other columns are not looked at."""
    sql = rewriting("documents_in", fim, spm)
    sql = DIGESTED.format(sql) if digests else f"SELECT doc_id, n, form, prefix_chars, middle_chars, output FROM ({sql})"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                for at, rows in _steps(batch.column("text")):
                    con.register("documents_in", pa.Table.from_batches([batch.slice(at, rows)]))
                    found = con.sql(sql).to_arrow_table()
                    con.unregister("documents_in")
                    yield from found.combine_chunks().to_batches()

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    made = "output_sha256 string, restored_sha256 string" if digests else "output string"
    return own.mapInArrow(rewrite, f"doc_id {dict(own.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, {made}")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), digests=True)


def oracle() -> str:
    """The same by character offsets: units end where the running sum of their lengths says."""
    h = ", ".join(f"CAST(('0x' || substr(sha256('1:' || CAST(doc_id AS VARCHAR)), {8 * k + 1}, 8)) AS BIGINT) AS h{k + 1}" for k in range(4))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {h} FROM documents
), units AS (SELECT r, unnest(u) AS u, generate_subscripts(u, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{UNIT}') AS u FROM docs)
), ends AS (SELECT r, i, sum(length(u)) OVER (PARTITION BY r ORDER BY i) AS upto FROM units
), sizes AS (SELECT r, count(*) AS n FROM units GROUP BY r
), placed AS (
  SELECT d.*, coalesce(n, 0) AS n, least(h1 % (coalesce(n, 0) + 1), h2 % (coalesce(n, 0) + 1)) AS a, greatest(h1 % (coalesce(n, 0) + 1), h2 % (coalesce(n, 0) + 1)) AS b,
         CASE WHEN text = '' OR text LIKE '%{PREFIX}%' OR text LIKE '%{SUFFIX}%' OR text LIKE '%{MIDDLE}%' OR h3 % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM docs d LEFT JOIN sizes USING (r)
), parted AS (
  SELECT p.doc_id, p.n, p.form, p.text, CAST(coalesce(x.upto, 0) AS BIGINT) AS x, CAST(coalesce(y.upto, 0) AS BIGINT) AS y
  FROM placed p LEFT JOIN ends x ON x.r = p.r AND x.i = p.a LEFT JOIN ends y ON y.r = p.r AND y.i = p.b)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || left(text, x) || '{SUFFIX}' || substr(text, y + 1) || '{MIDDLE}' || substr(text, x + 1, y - x)
                        ELSE '{SUFFIX}' || substr(text, y + 1) || '{PREFIX}' || left(text, x) || '{MIDDLE}' || substr(text, x + 1, y - x) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted"""
