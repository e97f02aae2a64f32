"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64 bits; two link where at most `radius` bits differ; components of links are groups.

1. Each distinct fingerprint counts once, so copies (however many) are one row from here on.
2. A vantage-point tree over a bounded sample (`SAMPLE_PER_SHARD` fingerprints for each shard, `MAX_SHARDS` shards)
   cuts the Hamming space into shards. Every fingerprint has one home shard. Where it lies within `radius` of a
   node's threshold on the inner side, it is also sent as a query to the outer side; a query goes on to every side
   that the triangle inequality leaves open. Each pair within the radius meets in the home shard of one of the two.
3. A shard is searched exactly with a tree of its own, pruned by the same bounds. It returns a spanning forest of the
   links found, never all pairs.
4. Shards' forests are merged by alternating large-star and small-star rounds on DataFrames.

The sample decides only where shards are cut: every fingerprint is searched and the links are exact.
Balls of random 64-bit strings overlap much: queries grow by about 1.4 for each doubling of the shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm import shingles
from pollveil.llm.common import cut, grown_partitions, stash, table

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints at home in a shard, about; most shards; sampled fingerprints for each shard.
SHARD_ROWS, MAX_SHARDS, SAMPLE_PER_SHARD = 4096, 4096, 32
#: Below so many fingerprints a shard's own tree compares them all.
BUCKET = 256


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text. Null, empty or blank: 0."""
    return shingles.majority(shingles.hashed(text, words, seed))


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fp", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """docs and a column of signed 64-bit fingerprints."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(to, of(F.col(text)))


@dataclass
class Node:
    """Inner: distance to vantage <= mu. A leaf has a shard and no vantage."""

    vantage: int = 0
    mu: int = 0
    inner: Node | None = None
    outer: Node | None = None
    shard: int = -1


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int64)


def _split(fps: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and the threshold that halves fps best; None where no distance parts them."""
    vantage = fps[len(fps) // 2]
    d = np.sort(distance(fps, vantage))
    mu = d[(len(d) - 1) // 2]
    if mu == d[-1]:
        lower = d[d < mu]
        if not len(lower):
            return None
        mu = lower[-1]
    return int(vantage), int(mu)


def build_tree(sample: np.ndarray, shards: int) -> tuple[Node, int]:
    """A tree with about `shards` leaves, and their number."""
    count = 0

    def grow(fps: np.ndarray, want: int) -> Node:
        nonlocal count
        cut_at = _split(fps) if want > 1 and len(fps) > 1 else None
        if cut_at is None:
            count += 1
            return Node(shard=count - 1)
        d = distance(fps, np.uint64(cut_at[0]))
        inside = d <= cut_at[1]
        left = min(want - 1, max(1, round(want * inside.mean())))
        return Node(*cut_at, grow(fps[inside], left), grow(fps[~inside], want - left))

    return grow(np.unique(sample), max(1, shards)), count


def route(tree: Node, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fps: positions, shards, and whether that is the home shard; the rest are queries."""
    found: list[tuple[np.ndarray, int, bool]] = []

    def walk(node: Node, at: np.ndarray, home: bool) -> None:
        if not len(at):
            return
        if node.inner is None:
            found.append((at, node.shard, home))
            return
        d = distance(fps[at], np.uint64(node.vantage))
        if home:
            walk(node.inner, at[d <= node.mu], True)
            walk(node.outer, at[d > node.mu], True)
            walk(node.outer, at[(d <= node.mu) & (d > node.mu - radius)], False)
        else:
            walk(node.inner, at[d <= node.mu + radius], False)
            walk(node.outer, at[d > node.mu - radius], False)

    walk(tree, np.arange(len(fps)), True)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return (np.concatenate([a for a, _, _ in found]), np.concatenate([np.full(len(a), s, np.int32) for a, s, _ in found]), np.concatenate([np.full(len(a), h) for a, _, h in found]))


def near_pairs(fps: np.ndarray, n_home: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (query, home) of pairs within the radius, by batches; the first n_home of fps are at home, all are
    queries."""

    def search(home: np.ndarray, query: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cut_at = _split(fps[home]) if len(home) > BUCKET else None
        if cut_at is None:
            step = max(1, (1 << 20) // max(1, len(home)))
            for i in range(0, len(query), step):
                q = query[i : i + step]
                a, b = np.nonzero(np.bitwise_count(fps[q][:, None] ^ fps[home][None, :]) <= radius)
                a, b = q[a], home[b]
                keep = (a > b) | (a >= n_home)
                if keep.any():
                    yield a[keep], b[keep]
            return
        vantage, mu = np.uint64(cut_at[0]), cut_at[1]
        dh, dq = distance(fps[home], vantage), distance(fps[query], vantage)
        yield from search(home[dh <= mu], query[dq <= mu + radius])
        yield from search(home[dh > mu], query[dq > mu - radius])

    if n_home:
        yield from search(np.arange(n_home), np.arange(len(fps)))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For n positions, the smallest position that links reach. Only roots are moved, so that links of earlier batches
    hold whatever later ones join."""
    root = np.arange(n)
    for a, b in pairs:
        while not (root[a] == root[b]).all():
            own, other = root[a], root[b]
            low = np.minimum(own, other)
            for x in (own, other):
                np.minimum.at(root, x, low)
            while not (root[root] == root).all():
                root = root[root]
    return root


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that join the same fingerprints as all links within the radius do. fps: distinct long `fp`."""
    n = fps.count()
    shards = min(MAX_SHARDS, max(1, -(-n // SHARD_ROWS)))
    sampled = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_PER_SHARD * shards + BUCKET).collect()  # a bounded sample: at most 131,328 longs
    tree, shards = build_tree(np.array([r.fp for r in sampled], np.int64).view(np.uint64), shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(own), 4096):
                part = own[i : i + 4096]
                at, shard, home = route(tree, part.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part[at]), pa.array(home)], ["shard", "fp", "home"])

    def search(one: pa.Table) -> pa.Table:
        home = one.column("home").to_numpy()
        own = one.column("fp").to_numpy()
        own = np.concatenate([np.sort(own[home]), own[~home]])
        root = forest(len(own), near_pairs(own.view(np.uint64), int(home.sum()), radius))
        linked = np.nonzero(root != np.arange(len(own)))[0]
        return pa.table({"u": own[linked], "v": own[root[linked]]})

    dealt = fps.select("fp").mapInArrow(send, "shard int, fp long, home boolean")
    dealt = dealt.repartition(grown_partitions(fps, shards, 4), "shard")
    return dealt.groupBy("shard").applyInArrow(search, "u long, v long").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v): root is the smallest node reachable.

    Alternating large-star and small-star rounds; each node of a star points to its centre at the end. Hubs are
    aggregated before they are shuffled, and the join back is one that adaptive execution can split."""

    def centre(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))

    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state or not state.n:
            break
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(centre(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(centre(large), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.unionAll(large.join(centre(large), "u").select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def group_by_fingerprint(marked: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, root, n_rows of the group, first_id of the group) for each distinct `fp` of marked."""
    fps = cut(marked.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")))
    found = components(links(fps, radius))
    rooted = cut(fps.join(found, fps.fp == found.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")))
    groups = rooted.groupBy("root").agg(F.min("low").alias("first_id"), F.sum("n").alias("n_rows"))
    return rooted.select("fp", "root").join(groups, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row for each row of docs: its id, the fingerprint (16 hex digits), the group's smallest id.

    Null, empty and blank texts have fingerprint 0 and link like any other; texts count as a whole, however long. Repeated
    ids keep their rows. A null id counts only where all of the group are null. An empty table gives no rows; other
    columns are not looked at."""
    marked = cut(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    groups = group_by_fingerprint(marked, radius=radius)
    hex_fp = F.lower(F.lpad(F.hex(marked.fp), 16, "0")).alias("fingerprint")
    return marked.join(groups, "fp").select("doc_id", hex_fp, F.col("first_id").alias("component_id"))


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """docs (id, text) -> id, key (of the set of shingles), n (its size), sketch and wide (shingles.sketch, wide_sketch), fp
    (fingerprint of the same shingles)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, sketch, wide, fp = [], [], [], [], []
            for t in batch.column("text"):
                h = shingles.hashed(t.as_py(), words)
                own = np.unique(h)
                key.append(shingles.set_key(own))
                n.append(len(own))
                sketch.append(shingles.sketch(own))
                wide.append(shingles.wide_sketch(own))
                fp.append(shingles.majority(h))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), pa.array(wide, pa.list_(pa.int64())), pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "key", "n", "sketch", "wide", "fp"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.mapInArrow(mark, f"id {dict(docs.dtypes)['id']}, key long, n long, sketch binary, wide array<long>, fp long")


def similar_groups(docs: DataFrame, words: int = shingles.SHINGLE_WORDS, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """For docs (id, text): its rows (id, key), and (key, root): keys of one root are joined by pairs of sets of
    `words` shingles whose Jaccard similarity is shingles.SIMILAR or more. Keys that are alone have no row.

    Fingerprints within the radius, found by vantage-point trees, and shingle prefixes propose pairs; each is checked on
    the whole sets. Fingerprints alone would miss most: 64 bits put a similarity of 0.8 up to a dozen bits apart, and no
    tree prunes at that radius."""
    docs = docs.select("id", F.col("text").cast("string").alias("text"))
    marked = stash(_marked(docs, words))
    fps = cut(marked.groupBy("fp").agg(F.min("key").alias("key")))
    close = links(fps, radius).join(fps.select(F.col("fp").alias("u"), F.col("key").alias("a")), "u").join(fps.select(F.col("fp").alias("v"), F.col("key").alias("b")), "v").select("a", "b")
    alike = marked.join(fps.select("fp", F.col("key").alias("a")), "fp").select("a", F.col("key").alias("b")).where("a <> b")
    pairs, groups = shingles.candidates(docs, marked, words)
    edges = shingles.similar(close.unionAll(alike).unionAll(pairs), docs, marked, words)
    roots = components(edges)
    more = cut(shingles.across(groups, roots, marked))
    if more.limit(1).count():
        found = shingles.similar(more, docs, marked, words)
        if found.limit(1).count():
            roots = components(edges.unionAll(found))
    return marked.select("id", "key"), roots.withColumnRenamed("node", "key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = shingles.SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """docs without all but one row of each group of near-duplicates (similar_groups): that with the smallest id (nulls
    last). The columns stay as they are, whatever their names.

    Texts without a word (null, empty, blank) are copies of each other. Very long texts are taken whole. Where ids are
    null or not unique, documents are told apart by their sets as well, and of rows alike in both any one is kept. An
    empty table gives no rows."""
    key, root, first = (f"__near_{x}" for x in ("key", "root", "first"))
    rows, roots = similar_groups(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), words, radius)
    own = rows.groupBy("key").agg(F.min("id").alias("low"))
    rooted = cut(own.join(roots, "key", "left").select("key", "low", F.coalesce("root", "key").alias("root")))
    least = rooted.groupBy("root").agg(F.min("low").alias("first"))
    if not rows.groupBy("id").count().where("count > 1 or id is null").limit(1).count():
        gone = cut(rows.join(rooted.join(least, "root").select("key", "first"), "key").where("id <> first").select(F.col("id").alias(first)))
        return docs.join(F.broadcast(gone) if gone.count() <= shingles.BROADCAST_ROWS else gone, F.col(id_col) == F.col(first), "left_anti")

    @F.pandas_udf("long")
    def key_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles.set_key(np.unique(shingles.hashed(t, words))) for t in texts], dtype="int64")

    known = rooted.join(least, "root").select(F.col("key").alias(key), F.col("root").alias(root), F.col("first").alias(first))
    joined = docs.withColumn(key, key_of(F.col(text).cast("string"))).join(known, key)
    return joined.where(F.col(id_col).eqNullSafe(F.col(first))).dropDuplicates([root]).select(*docs.columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
