"""Line deduplication over levelled sorted runs of line hashes, with DataFrame functions alone.

`LineRuns` holds what was seen so far as runs: tables of (h1, h2, n), the two halves of a line's 128-bit hash and in how
many documents it stood, bucketed by the hash and sorted within buckets. A new batch of documents is counted by line and
merge-anti-joined with the runs, for which no run is shuffled again. What is left is added as a run of
level 0; FANOUT runs of a level are merged into one of the next, so that a hash is rewritten once a level and the number of
runs grows with the logarithm of the batches'. Lines that the runs already hold often enough need no more counting, and
are what the anti-join takes out: a line that a third of all documents share stops costing anything.

`drop_frequent` takes lines of at least min_docs documents out of every document. Their hashes are broadcast while there
are at most BROADCAST_KEYS of them. Beyond that only the commonest are: those that stand in 1 / BROADCAST_KEYS of all
(document, line) pairs or more, of which there can be no more than BROADCAST_KEYS; no key that is left for the shuffled
join is then a hot one. A document's dropped line numbers come back to it by a hash of id and text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm.common import ascii_lower, checkpoint_folder, cut, stash, table

#: Runs of a level that are merged into one of the next.
FANOUT = 3
#: Batches in which the query hands its documents to the runs.
BATCHES = 4
#: Hashes (about 10 MB) and dropped line numbers (about 10 MB) that are broadcast at most.
BROADCAST_KEYS, BROADCAST_PLACES = 200_000, 1_000_000
# Fixed values of the contract: white space around a line, documents that make a line frequent, code points of a key.
BLANKS = " \t\n\x0b\x0c\r"
MIN_DOCS, MIN_CHARS = 10, 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keys_of(text: Column) -> Column:
    """The key of each line: A-Z in lower case, no white space around."""
    own = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(own) == F.char_length(own), F.lower(own)).otherwise(ascii_lower(own))  # the short way for plain ASCII
    return F.transform(F.split(lower, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def _hashes(key: Column) -> dict[str, Column]:
    return {"h1": F.xxhash64(key), "h2": F.xxhash64(F.lit(1), key)}


def line_counts(docs: DataFrame, text: str = "text", *by: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(by..), h1, h2, n: in how many documents each line of at least min_chars characters stands. Lines are made distinct
    within their row, and counted before the shuffle."""
    own = docs.select(*by, F.explode(F.array_distinct(keys_of(F.col(text)))).alias("key")).where(F.char_length("key") >= min_chars)
    return own.select(*by, *(c.alias(n) for n, c in _hashes(F.col("key")).items())).groupBy(*by, "h1", "h2").agg(F.count("*").alias("n"))


class LineRuns:
    """The runs, by level. They lie in the shared checkpoint folder and go when the session's JVM ends."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.levels: list[list[str]] = [[]]

    @property
    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, counts: DataFrame) -> str:
        name, sc = f"line_run_{uuid.uuid4().hex}", self.spark.sparkContext
        path = f"{checkpoint_folder(self.spark)}/{name}"
        counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
        return name

    def _drop(self, name: str) -> None:
        sc = self.spark.sparkContext
        self.spark.sql(f"DROP TABLE {name}")
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(self.spark)}/{name}")
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)

    def unseen(self, counts: DataFrame, enough: int = 1) -> DataFrame:
        """counts without the hashes that a run holds in at least `enough` documents: one merge join a run."""
        for run in self.runs:
            counts = counts.join(run.where(F.col("n") >= enough).hint("merge"), ["h1", "h2"], "left_anti")
        return counts

    def add(self, counts: DataFrame, enough: int = 1) -> None:
        """Adds what is unseen of a batch (h1, h2, n; each hash once) as a run, and compacts."""
        self.levels[0].append(self._write(self.unseen(counts, enough).select("h1", "h2", "n")))
        k = 0
        while len(self.levels[k]) >= self.fanout:
            self._compact(k)
            k += 1

    def _compact(self, k: int) -> None:
        if len(self.levels) == k + 1:
            self.levels.append([])
        merged = self._write(self._sum(self.levels[k]))
        self.levels[k + 1].append(merged)
        old, self.levels[k] = self.levels[k], []
        for name in old:
            self._drop(name)

    def _sum(self, names: list[str]) -> DataFrame:
        """h1, h2, n over runs. They are read as plain files: an aggregate above a union of bucketed scans takes these for
        aligned when they are not, and leaves a key in two rows (Spark 4.1)."""
        paths = [f"{checkpoint_folder(self.spark)}/{n}" for n in names]
        return self.spark.read.schema("h1 long, h2 long, n long").parquet(*paths).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        """h1, h2, n over all runs."""
        names = [name for level in self.levels for name in level]
        return self._sum(names) if names else self.spark.createDataFrame([], "h1 long, h2 long, n long")

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = [[]]


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """h1, h2, n of lines that at least min_docs documents hold, by way of runs: documents are dealt to batches by a hash of
    their id. n is exact below min_docs, and at least min_docs where a line has so many."""
    own = docs.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)).cast("int").alias("batch"), F.col(text).cast("string").alias("text"))
    counted = stash(line_counts(own, "text", "batch", min_chars=min_chars))
    runs = LineRuns(docs.sparkSession, fanout=fanout)
    for b in range(batches):
        runs.add(counted.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.sum("n").alias("n")), enough=min_docs)
    found = cut(runs.counts().where(F.col("n") >= min_docs))
    runs.close()
    return found


def _row_key(id_col: str, text: str) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.col(text)).alias("k1"), F.xxhash64(F.lit(1), F.col(id_col), F.col(text)).alias("k2")]


def dropped_places(docs: DataFrame, frequent: DataFrame, min_chars: int = MIN_CHARS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """k1, k2 (a document's key), places (its frequent lines' numbers, sorted) for documents (doc_id, text) that have any."""
    size = frequent.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).first()
    own = docs.select(*_row_key("doc_id", "text"), F.posexplode(keys_of(F.col("text"))).alias("place", "key")).where(F.char_length("key") >= min_chars)
    own = own.select("k1", "k2", "place", *(c.alias(n) for n, c in _hashes(F.col("key")).items()))
    keys = frequent.select("h1", "h2", (F.lit(size.keys <= broadcast_keys) | (F.col("n") * F.lit(broadcast_keys) >= F.lit(size.pairs))).alias("hot"))
    found = own.join(F.broadcast(keys.where("hot").drop("hot")), ["h1", "h2"], "left_semi")  # at most broadcast_keys hashes
    if size.keys > broadcast_keys:
        found = found.unionByName(own.join(keys.where("not hot").drop("hot"), ["h1", "h2"], "left_semi"))
    return found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("place")).alias("places"))


def drop_frequent(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS, broadcast_places: int = BROADCAST_PLACES) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept (the lines left, joined by line feeds): a row for each row of docs.

    A line counts once for each row it stands in, whatever the row's id: repeated rows count each. Null and empty texts
    are one empty line, which is never dropped; texts are taken whole, however long. Rows with a null id are rows like any
    other. An empty table gives no rows; other columns are not looked at."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    frequent = frequent_lines(own, "doc_id", "text", min_docs, min_chars, batches)
    places = cut(dropped_places(own, frequent, min_chars, broadcast_keys))
    total = places.agg(F.coalesce(F.sum(F.size("places") + 1), F.lit(0)).alias("n")).first().n
    keyed = own.select("doc_id", "text", *_row_key("doc_id", "text"))
    joined = keyed.join(F.broadcast(places) if total <= broadcast_places else places, ["k1", "k2"], "left")
    lines, n = F.col("lines"), F.size("lines")
    ends = F.concat(F.array(F.lit(-1)), F.col("places"), F.array(n))
    rows = joined.select("doc_id", "text", "places", lines_of(F.col("text")).alias("lines")).withColumn("ends", F.when(F.col("places").isNotNull(), ends))
    # Stretches between dropped lines, each cut out once: linear in the text whatever is dropped.
    between = F.transform(F.sequence(F.lit(0), F.size("places")), lambda i: F.slice(lines, F.get("ends", i) + 2, F.get("ends", i + 1) - F.get("ends", i) - 1))
    kept = F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(between), "\n"))
    return rows.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_frequent(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (SELECT r, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM docs
), keyed AS (SELECT r, i, line, trim(translate(line, '{upper}', '{lower}'), {blanks}) AS k FROM lines
), frequent AS (SELECT k FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {MIN_DOCS}
), marked AS (SELECT r, i, line, k IN (SELECT k FROM frequent) AS gone FROM keyed)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked JOIN docs USING (r) GROUP BY r"""
