"""License scans by a positional rare-token index, with DataFrame functions alone.

Templates are notices and whole short licenses. Words' document frequencies over the whole corpus give their IDF; each
template is posted under its words of highest IDF, with their positions. A file's words that have postings propose
(template, shift) pairs; a pair holds if enough of the template's posted words stand in the file at their positions moved
by the shift. Mandatory key phrases must then stand there word by word. Phrases of the base are sought in every file as
they are.

Templates are data (arrays and a map of postings), so that their number does not make expressions longer. Proposals are
sorted once: a file's work grows with its hits, not with their square.

Words are runs of digits, ASCII letters and non-ASCII characters, with A-Z in lower case."""

from __future__ import annotations

import math
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm.common import LOWER, UPPER, ascii_lower, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the base.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Label, text, key phrase of each template: notices, and the standing text of short licenses.
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license"),
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "you may not use this file except in compliance with the license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "permission is granted to anyone to use this software for any purpose"),
    ("bsl-1.0", "boost software license version 1 0", "boost software license version 1 0"),
]
#: Posted words a template at most; a word must be in less than this share of the files, unless it is a template's rarest.
INDEXED, MAX_SHARE = 4, 0.1
#: Share of a template's posted words that must stand at their places.
NEED = 0.6
_TEMPLATE = 1 << 40  # a candidate is template * _TEMPLATE + shift + _SHIFT
_SHIFT = 1 << 20


def words_of(text: Column) -> Column:
    """Words joined by single blanks."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS, " "))


def document_frequency(files: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Files, and how many have each word of a bounded vocabulary."""
    n = files.count()
    found = files.select(F.explode(F.array_intersect(F.split(words_of(F.col(text)), " "), F.lit(vocabulary))).alias("w")).groupBy("w").count()
    return n, {r["w"]: r["count"] for r in found.collect()}


def index(templates: list[tuple[str, str, str]], n: int, df: dict[str, int]) -> list[list[tuple[str, int]]]:
    """For each template its posted words with their positions, highest IDF (least document frequency) first; equals by
    word and position."""
    out = []
    for _, notice, _ in templates:
        own = sorted((df.get(w, 0), w, p) for p, w in enumerate(notice.split()))
        rare = [x for x in own if x[0] < MAX_SHARE * max(1, n)] or own[:1]
        out.append([(w, p) for _, w, p in rare[:INDEXED]])
    return out


def key_place(notice: str, key: str) -> int:
    """Where a key phrase's words stand in its notice."""
    words, phrase = notice.split(), key.split()
    for i in range(len(words) - len(phrase) + 1):
        if words[i : i + len(phrase)] == phrase:
            return i
    raise ValueError(f"the key phrase {key!r} is not in its notice")


def scan(files: DataFrame, templates: list[tuple[str, str, str]], base: list[tuple[str, str]], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches: a row for each row of files.

    score: over the templates that hold, the largest share of posted words in place; 0 where none does. matches: label
    and first word of each, equal ones once. Null and empty texts have no word and no label; texts are read whole,
    however long; repeated rows give equal rows and count each in document frequencies. An empty table gives no rows;
    other columns are not looked at. A key phrase that is not in its notice raises ValueError."""
    own = files.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    n, df = document_frequency(own, sorted({w for _, notice, _ in templates for w in notice.split()}))
    posted = index(templates, n, df)
    rare = sorted({w for t in posted for w, _ in t})
    postings = F.create_map(*(x for w in rare for x in (F.lit(w), F.lit([t * _TEMPLATE - p + _SHIFT for t, own in enumerate(posted) for v, p in own if v == w]))))
    needs, sizes = F.lit([math.ceil(NEED * len(p)) for p in posted]), F.lit([float(len(p)) for p in posted])
    keys, key_at = F.array(*(F.lit(key.split()) for _, _, key in templates)), F.lit([key_place(notice, key) for _, notice, key in templates])

    words, plain, none = F.col("words"), F.concat(F.lit(" "), F.col("norm"), F.lit(" ")), F.expr("cast(array() as array<int>)")
    has = {phrase: plain.contains(f" {phrase} ") for phrase, _ in base}

    def places(phrase: str) -> Column:
        own = phrase.split()
        return F.when(has[phrase], F.filter(F.sequence(F.lit(0), F.size(words) - len(own)), lambda i: reduce(and_, (F.get(words, i + k) == w for k, w in enumerate(own))))).otherwise(none)

    def template(c: Column) -> Column:
        return F.floor(c / F.lit(_TEMPLATE)).cast("int")

    def shift(c: Column) -> Column:
        return (F.pmod(c, F.lit(_TEMPLATE)) - _SHIFT).cast("int")

    def first_of_run(c: Column, i: Column) -> Column:
        """The candidate and how many of its posted words are in place, at its first of enough equal proposals."""
        at = lambda k: F.get(F.col("proposed"), i + k)
        n = reduce(add, (F.coalesce((at(k) == c).cast("int"), F.lit(0)) for k in range(INDEXED)))
        return F.when(((i == 0) | (at(-1) != c)) & (n >= F.get(needs, template(c))), F.struct(c.alias("c"), n.alias("n")))

    def key_stands(x: Column) -> Column:
        phrase, begin = F.get(keys, template(x.c)), shift(x.c) + F.get(key_at, template(x.c))
        return F.size(F.filter(phrase, lambda w, k: F.coalesce(F.get(words, begin + k) == w, F.lit(False)))) == F.size(phrase)

    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(rare))
    proposed = F.array_sort(F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(postings, F.get(words, i)), lambda p: p + i))))
    label = lambda c: F.get(F.lit([name for name, _, _ in templates]), template(c))
    rows = own.select("doc_id", words_of(F.col("text")).alias("norm")).select("doc_id", "norm", F.when(F.col("norm") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("norm", " ")).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.flatten(F.array(*(places(p) for p, _ in base))).alias("places"), F.array_compact(F.array(*(F.when(has[p], F.lit(name)) for p, name in base))).alias("base"), F.when(F.size("words") > 0, proposed).otherwise(F.expr("cast(array() as array<bigint>)")).alias("proposed"), "words")
    rows = rows.withColumn("held", F.filter(F.array_compact(F.transform("proposed", first_of_run)), key_stands))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("held", lambda x: label(x.c))))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("held", lambda x: x.n / F.get(sizes, template(x.c)))), F.lit(0.0)).alias("score"),
        F.array_sort(F.array_distinct(F.transform("held", lambda x: F.concat(label(x.c), F.lit("@"), shift(x.c).cast("string"))))).alias("matches"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), TEMPLATES, BASE).withColumn("matches", F.array_join("matches", ","))


def oracle() -> str:
    rows = ", ".join(f"({t}, '{label}', string_split('{notice}', ' '), string_split('{key}', ' '), {key_place(notice, key)})" for t, (label, notice, key) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in BASE)
    return f"""
WITH templates AS (SELECT * FROM (VALUES {rows}) v(t, label, notice, key, key_at)
), base AS (SELECT * FROM (VALUES {phrases}) v(label, phrase)
), files AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), template_words AS (SELECT t, unnest(notice) AS w, generate_subscripts(notice, 1) - 1 AS p FROM templates
), places AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM files
), frequency AS (SELECT w, count(DISTINCT r) AS n FROM places WHERE w IN (SELECT w FROM template_words) GROUP BY w
), ranked AS (SELECT t, w, p, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), w, p) AS k FROM template_words LEFT JOIN frequency USING (w)
), posted AS (SELECT t, w, p, count(*) OVER (PARTITION BY t) AS size FROM ranked WHERE k <= {INDEXED} AND (k = 1 OR n < {MAX_SHARE} * greatest(1, (SELECT count(*) FROM files)))
), proposed AS (SELECT r, t, i - p AS shift, count(*) AS n, any_value(size) AS size FROM places JOIN posted USING (w) GROUP BY r, t, i - p HAVING count(*) >= ceil({NEED} * any_value(size))
), held AS (
  SELECT p.r, t.label, p.shift, p.n / p.size AS share FROM proposed p JOIN templates t USING (t) JOIN files f USING (r)
  WHERE shift + key_at >= 0 AND list_slice(words, shift + key_at + 1, shift + key_at + len(key)) = key
), found AS (SELECT p.r, b.label, p.i FROM places p JOIN files f USING (r), base b WHERE p.w = b.phrase[1] AND list_slice(f.words, p.i + 1, p.i + len(b.phrase)) = b.phrase
), counted AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found GROUP BY r
), labelled AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM found UNION ALL SELECT r, label FROM held) GROUP BY r
), scored AS (SELECT r, max(share) AS score, string_agg(DISTINCT concat(label, '@', shift), ',' ORDER BY concat(label, '@', shift)) AS matches FROM held GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(matches, '') AS matches
FROM files LEFT JOIN counted USING (r) LEFT JOIN labelled USING (r) LEFT JOIN scored USING (r)
"""
