"""Token counts by offset-mapped attribution.

Whole documents are encoded once: the fields of a row are joined by SEPARATOR, and each field is cut into sections
that end behind each line break. Ids of a byte-level vocabulary tile the text's bytes, so that the running sum of
their lengths gives each token's span. Both lists of intervals are in order and lie in one row; they are joined by
binary search in the task, with no shuffle. A token that crosses a boundary is allocated by an explicit rule:

first     to the section of its first byte
last      to the section of its last byte
majority  to the section with most of its bytes, the earliest of equals
split     to each section, in proportion to its bytes"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm.common import table
from pollveil.llm.tokenize import default_path, tokenizer

SEPARATOR = "\n"
RULES = ("first", "last", "majority", "split")
STEP = 256


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Both arrays hold running sums of bytes with one total; sections may be empty."""
    n = len(section_ends)
    if not len(token_ends):
        return np.zeros(n)
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    if rule in ("first", "last"):
        return np.bincount(first if rule == "first" else last, minlength=n).astype(float)
    out = np.bincount(first[first == last], minlength=n).astype(float)
    across = np.nonzero(first != last)[0]
    if len(across):
        count = last[across] - first[across] + 1
        token = np.repeat(across, count)
        section = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[token]
        begin = np.concatenate([[0], section_ends[:-1]])[section]
        shared = np.minimum(section_ends[section], token_ends[token]) - np.maximum(begin, starts[token])
        if rule == "split":
            np.add.at(out, section, shared / (token_ends - starts)[token])
        else:
            order = np.lexsort((section, -shared, token))
            best = order[np.concatenate([[True], token[order][1:] != token[order][:-1]])]
            out += np.bincount(section[best], minlength=n)
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), path: str | None = None, rule: str = "majority") -> DataFrame:
    """doc_id, field, section, start_char, end_char (in the field), n_tokens, doc_tokens: a row for each section.

    n_tokens of a document add up to doc_tokens. The separator between two fields belongs to the last section of the
    earlier one. A null field counts as empty and has one empty section. Texts are encoded whole, however long. Repeated
    rows are counted each. An empty table gives no rows; other columns are not looked at."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                some = batch.slice(i, STEP)
                values = [[v or "" for v in some.column(1 + k).to_pylist()] for k in range(len(fields))]
                row, name, section, start, end, n, total = [], [], [], [], [], [], []
                for r, texts in enumerate(zip(*values, strict=True)):
                    ids = tok.encode_document(SEPARATOR.join(texts))
                    sizes = []
                    for k, text in enumerate(texts):
                        lines = text.split("\n")
                        ends = np.cumsum([len(x) + 1 for x in lines])
                        ends[-1] -= 1
                        size = np.array([len(x.encode()) + 1 for x in lines])
                        size[-1] += len(SEPARATOR) * (k + 1 < len(texts)) - 1
                        sizes.append(size)
                        name.append(np.full(len(lines), k, np.int32))
                        section.append(np.arange(len(lines)))
                        start.append(np.concatenate([[0], ends[:-1]]))
                        end.append(ends)
                    n.append(allocate(np.cumsum(tok.n_bytes[ids]), np.cumsum(np.concatenate(sizes)), rule))
                    row.append(np.full(len(n[-1]), r))
                    total.append(np.full(len(n[-1]), len(ids)))
                names = pa.array(fields).take(pa.array(np.concatenate(name)))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(np.concatenate(row))), names, *(pa.array(np.concatenate(x).astype(np.int64)) for x in (section, start, end)), pa.array(np.concatenate(n)), pa.array(np.concatenate(total))], ["doc_id", "field", "section", "start_char", "end_char", "n_tokens", "doc_tokens"])

    own = docs.select(F.col(id_col).alias("doc_id"), *(F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)))
    return own.mapInArrow(count, f"doc_id {dict(own.dtypes)['doc_id']}, field string, section long, start_char long, end_char long, n_tokens double, doc_tokens long")


def op2_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("n_tokens", F.col("n_tokens").cast("long"))
