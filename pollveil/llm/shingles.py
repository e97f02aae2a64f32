"""Pairs of documents whose sets of word shingles are similar (Jaccard), found and checked exactly.

SimHash links of a few bits miss most pairs of similarity 0.8; this module completes them for `simhash.keep_one`.

1. A document is the set of its hashed shingles; equal sets are one node (`key`).
2. Two sets of similarity s share a shingle among the first n - ceil(s n) + 1 of each, in any order that is the same for
   all (prefix filter). Shingles that a sample finds often come last; the sample decides only the cost.
3. Only prefixes are shuffled, packed by buckets of the hash. Nodes with a shingle in common are paired with the one
   whose SimHash is nearest to the group's majority (of edited copies that is the original, or close to it); groups of
   the same nodes are one. Nodes that these pairs, once checked, leave outside a group's largest component are compared
   with all others of the group. Sizes and positions rule out pairs that cannot be similar.
4. Sketches of SKETCH_BITS bits, each the parity of the shingles that fall on it, differ in no more bits than the sets do
   in shingles: pairs whose sketches differ too much are out. Sets of more shingles than that have a second sketch, as
   long as the set, that decides before whole sets are moved.
5. Every other pair is checked on the whole sets, made again from one text for each node in question."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollveil.llm.common import cut, grown_partitions, stash

SHINGLE_WORDS, SEED = 5, 42
#: Similarity as a fraction, so that the bounds are whole numbers.
SIMILAR = (4, 5)
#: Documents whose shingles are counted for the order, and shingles that the order tells apart at most (4 MB).
SAMPLE, MAX_FREQUENT = 1 << 13, 1 << 18
#: Postings of a bucket, about (20 MB in a task); postings that a task packs at once.
BUCKET_POSTINGS, PACK_POSTINGS, PACK_DOCUMENTS = 1 << 20, 1 << 19, 1 << 16
#: Keys and ids that are broadcast at most (32 MB); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
STEP = 256
SKETCH_BITS = 1024
#: Hashes whose bits are added up at once.
CHUNK = 1 << 16


def hashed(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of the shingles of a text, repeats included. A shorter text is one shingle; null, empty or blank: none."""
    import xxhash

    own = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is \x20 \x09-\x0D
    grams = zip(*(own[i:] for i in range(words)), strict=False) if len(own) >= words else [own] if own else []
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(g), seed) for g in grams), np.uint64)


def majority(h: np.ndarray) -> int:
    """The unsigned 64-bit number of the bits that are set in over half of h; 0 for no hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        part = h[at : at + CHUNK].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h), bitorder="little").tobytes(), "little")


def set_key(own: np.ndarray) -> int:
    """A signed number for a set of hashes (sorted, unique)."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.astype("<u8").tobytes())).view(np.int64))


def sketch(own: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parities of the hashes by their lowest bits; one half xor the other is the sketch of half the length."""
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_sketch(own: np.ndarray) -> np.ndarray | None:
    """The second sketch of a large set, in 64-bit numbers: a power of two of bits, one or two for each hash."""
    return np.frombuffer(sketch(own, 1 << (len(own) - 1).bit_length()), np.int64) if len(own) > SKETCH_BITS else None


def needed(a, b):
    """Shingles that sets of a and b shingles share at least where they are similar."""
    up, down = SIMILAR
    return -(-up * (a + b) // (up + down))


def prefix_size(n):
    """Shingles of a set of n that are in its prefix."""
    up, down = SIMILAR
    return n - -(-up * n // down) + 1


def _frequent(docs: DataFrame, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in two sampled documents or more, sorted, and how many each is in."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashed(t.as_py(), words)).view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, rows)))).dropDuplicates(["text"])
    found = some.select("text").mapInArrow(explode, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _packed(docs: DataFrame, frequent: np.ndarray, count: np.ndarray, buckets: int, words: int) -> DataFrame:
    """The prefixes of all sets by bucket of the hash: bucket, h (8 bytes each), at and pos (2 bytes each), key, n and fp
    of the documents that `at` counts. Copies in a task are skipped while they are remembered."""

    def pack(own: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        h = np.concatenate([p for *_, p in own])
        sizes = np.array([len(p) for *_, p in own])
        at = np.repeat(np.arange(len(own)), sizes)
        pos = np.minimum(np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes), 65535)  # a smaller one rules out less
        key, n, fp = np.array([k for k, *_ in own], np.int64), np.array([n for _, n, *_ in own], np.uint32), np.array([f for _, _, f, _ in own], np.uint64)
        bucket = (h >> np.uint64(40)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        rows: list[tuple] = []
        for b, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            if i < j:
                some = order[i:j]
                docs_here, local = np.unique(at[some], return_inverse=True)
                rows.append((b, h[some].tobytes(), local.astype(np.uint16).tobytes(), pos[some].astype(np.uint16).tobytes(), key[docs_here].tobytes(), n[docs_here].tobytes(), fp[docs_here].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)], ["bucket", "h", "at", "pos", "key", "n", "fp"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[int, int, int, np.ndarray]] = []
        size = 0
        for batch in batches:
            for text in batch.column(0):
                every = hashed(text.as_py(), words)
                own = np.unique(every)
                k = set_key(own)
                if k in seen or not len(own):
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(k)
                n = len(own)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    own = own[np.argsort(np.where(frequent[place] == own, count[place], 0), kind="stable")]
                held.append((k, n, majority(every), own[: prefix_size(n)]))
                size += len(held[-1][3])
                if size >= PACK_POSTINGS or len(held) >= PACK_DOCUMENTS:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return docs.select("text").mapInArrow(emit, "bucket int, h binary, at binary, pos binary, key binary, n binary, fp binary")


def _may_link(n, pos, i, j) -> np.ndarray:
    return np.minimum(n[i] - pos[i], n[j] - pos[j]) >= needed(n[i], n[j])


def _search(bucket: pa.Table) -> pa.Table:
    """Pairs (gid null) of each group's centre with the others, and the rows (b null) of groups of three or more: gid,
    a, n, pos. A group's number is made of its nodes, so that groups of the same nodes are one."""
    parts = []
    for h, at, pos, key, n, fp in zip(*(bucket.column(c).to_pylist() for c in ("h", "at", "pos", "key", "n", "fp")), strict=True):
        at = np.frombuffer(at, np.uint16)
        parts.append((np.frombuffer(h, np.uint64), np.frombuffer(key, np.int64)[at], np.frombuffer(n, np.uint32)[at].astype(np.int64), np.frombuffer(pos, np.uint16).astype(np.int64), np.frombuffer(fp, np.uint64)[at]))
    h, key, n, pos, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((key, h))
    keep = np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(key[order]) != 0)])
    h, key, n, pos, fp = (x[order][keep] for x in (h, key, n, pos, fp))
    begins = np.concatenate([[True], h[1:] != h[:-1]])
    shared = ~begins | np.append(~begins[1:], False)  # in a group of two or more
    h, key, n, pos, fp, begins = (x[shared] for x in (h, key, n, pos, fp, begins))
    first = np.nonzero(begins)[0]
    group = np.cumsum(begins) - 1
    size = np.bincount(group)
    centre = first[group]
    if len(first):
        ones = np.add.reduceat(np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1), first, axis=0, dtype=np.int32)
        middle = np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64)[:, 0]
        order = np.lexsort((key, np.bitwise_count(fp ^ middle[group]), group))
        centre = order[first][group]
    j = np.nonzero(centre != np.arange(len(h)))[0]
    i = centre[j]
    ok = _may_link(n, pos, i, j)
    pairs = np.unique(np.stack([np.minimum(key[i[ok]], key[j[ok]]), np.maximum(key[i[ok]], key[j[ok]])]), axis=1)

    mixed = (key.view(np.uint64) ^ (key.view(np.uint64) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    gid = np.add.reduceat(mixed, first).view(np.int64) if len(first) else np.zeros(0, np.int64)
    wide = np.nonzero(size > 2)[0]
    _, one, same = np.unique(np.stack([gid[wide], size[wide]]), axis=1, return_index=True, return_inverse=True)
    # Nodes stand in the order of their keys, so that equal groups are equal place by place.
    members = np.nonzero(size[group] > 2)[0]
    rank = members - first[group[members]]
    of = np.full(len(size), -1)
    of[wide] = same
    begin = np.cumsum(size[wide][one]) - size[wide][one]
    slot = begin[of[group[members]]] + rank
    total = int(size[wide][one].sum())
    low = np.full(total, np.iinfo(np.int64).max)
    np.minimum.at(low, slot, pos[members])
    k, m, g = (np.zeros(total, np.int64) for _ in range(3))
    k[slot], m[slot], g[slot] = key[members], n[members], gid[group[members]]
    blank, none = pa.nulls(pairs.shape[1], pa.int64()), pa.nulls(total, pa.int64())
    columns = [(blank, g), (pairs[0], k), (pairs[1], none), (blank, m), (blank, low)]
    return pa.table({c: pa.concat_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())]) for c, (x, y) in zip(("gid", "a", "b", "n", "pos"), columns, strict=True)})


def candidates(docs: DataFrame, marked: DataFrame, words: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of keys to check first, and groups (gid, key, n, pos) whose nodes are to be compared in full where
    those pairs leave them apart. docs has `text`; marked has a row with `n`, the size of the set, for each of docs."""
    size = marked.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]) + 1), F.lit(0)).alias("postings")).first()
    buckets = grown_partitions(docs, int(size.postings), BUCKET_POSTINGS)
    packed = _packed(docs, *_frequent(docs, size.rows, words), buckets, words)
    found = stash(packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_search, "gid long, a long, b long, n long, pos long"))
    groups = found.where("gid is not null").groupBy("gid", F.col("a").alias("key")).agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
    return found.where("gid is null").select("a", "b"), groups


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut only between values of the first column."""
    carry: list[np.ndarray] | None = None
    for batch in batches:
        own = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        if carry is not None:
            own = [np.concatenate(x) for x in zip(carry, own, strict=True)]
        if not len(own[0]):
            continue
        cut_at = int(np.searchsorted(own[0], own[0][-1]))
        carry = [x[cut_at:] for x in own]
        if cut_at:
            yield [x[:cut_at] for x in own]
    if carry is not None and len(carry[0]):
        yield carry


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a group that are in different components and may be similar by their sizes, positions and sketches.
    Rows: gid, key, n, pos, root, sketch (its 64-bit words in columns of their own); sorted by gid, n."""
    up, down = SIMILAR
    for gid, key, n, pos, root, *words in _sorted_groups(batches):
        sketches = np.stack(words, axis=1).view(np.uint64)  # bits of a negative number would not be counted
        ends = np.append(np.nonzero(np.diff(gid))[0] + 1, len(gid)).tolist()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in zip([0, *ends[:-1]], ends, strict=True):
            names, counts = np.unique(root[low:high], return_counts=True)
            home = root[low:high] == names[counts.argmax()]
            own = n[low:high]
            for i in np.nonzero(~home)[0].tolist():
                a, b = np.searchsorted(own, -(-up * own[i] // down)), np.searchsorted(own, down * own[i] // up, "right")
                j = np.arange(a, b)
                j = j[(home[a:b] | (j > i)) & (root[low + a : low + b] != root[low + i])]
                j = j[_may_link(n, pos, low + i, low + j)]
                apart = np.bitwise_count(sketches[low + j] ^ sketches[low + i]).sum(axis=1, dtype=np.int64)
                j = low + j[apart <= own[i] + own[j] - 2 * needed(own[i], own[j])]
                if len(j):
                    found.append((np.full(len(j), key[low + i]), key[j]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def across(groups: DataFrame, roots: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of each group's nodes that roots (node, root) leave in different components and that may be similar."""
    own = groups.join(roots.withColumnRenamed("node", "key"), "key", "left").select("gid", "key", "n", "pos", F.coalesce("root", "key").alias("root"))
    mixed = own.groupBy("gid").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("gid")
    own = cut(own.join(mixed, "gid", "left_semi"))
    parts = grown_partitions(own, own.count(), 1 << 18)
    nodes = own.select("key").distinct()
    sketches = marked.join(nodes, "key", "left_semi").groupBy("key").agg(F.first("sketch").alias("sketch"))
    words = [F.conv(F.hex(F.substring("sketch", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"s{i}") for i in range(SKETCH_BITS // 64)]
    rows = own.join(sketches.select("key", *words), "key").select("gid", "key", "n", "pos", "root", *(f"s{i}" for i in range(SKETCH_BITS // 64)))
    return rows.repartition(parts, "gid").sortWithinPartitions("gid", "n", "key").mapInArrow(_across, "a long, b long").distinct()


def _apart(x: Column, y: Column) -> Column:
    """Bits in which two wide sketches differ. The longer one is folded; similar sets are one fold apart at most."""

    def folded(c: Column, to: Column) -> Column:
        half = F.zip_with(F.slice(c, F.lit(1), to), F.slice(c, to + 1, to), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(c) == 2 * to, half).otherwise(c)

    short = F.least(F.size(x), F.size(y))
    bits = F.zip_with(folded(x, short), folded(y, short), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def _sketched(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches and sizes do not rule them out; loses no similar pair."""
    own = marked.groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    both = pairs.join(own.select(F.col("key").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x")), "a")
    both = both.join(own.select(F.col("key").alias("b"), "n", F.col("sketch").alias("y")), "b").select("a", "b", "m", "n", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = batch.column("m").to_numpy(), batch.column("n").to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64) for c in ("x", "y"))
            most = m + n - 2 * needed(m, n)
            keep = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most
            large = np.minimum(m, n) > SKETCH_BITS
            columns = [*(batch.column(c) for c in ("a", "b")), pa.array(most, pa.int64()), pa.array(large)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in columns], ["a", "b", "most", "large"])

    kept = cut(both.mapInArrow(check, "a long, b long, most long, large boolean"))
    large = kept.where("large")
    names = large.select(F.col("a").alias("key")).unionAll(large.select(F.col("b").alias("key"))).distinct()
    wide = marked.where("wide is not null").select("key", "wide").join(names, "key", "left_semi").groupBy("key").agg(F.first("wide").alias("wide"))
    large = large.join(wide.select(F.col("key").alias("a"), F.col("wide").alias("x")), "a").join(wide.select(F.col("key").alias("b"), F.col("wide").alias("y")), "b")
    return kept.where("not large").select("a", "b").unionAll(large.where(_apart(F.col("x"), F.col("y")) <= F.col("most")).select("a", "b"))


def similar(pairs: DataFrame, docs: DataFrame, marked: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets are similar, as (u, v). docs has id and text; marked id, key, n and the
    sketches. A node's set is made from the texts of its smallest id, or, where that is null, of all null ids."""
    up, down = SIMILAR
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs = cut(_sketched(pairs, marked))
    keys = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()
    keys = cut(marked.select("key", "id").join(keys, "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")))
    few = keys.count() <= BROADCAST_ROWS

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashes of each text; of texts that came with a key, only those that have it."""
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                want = batch.column(0).slice(i, STEP).to_pylist()
                own = [np.unique(hashed(t.as_py(), words)) for t in batch.column(1).slice(i, STEP)]
                key = [set_key(x) for x in own]
                keep = [j for j, (k, w) in enumerate(zip(key, want, strict=True)) if w is None or k == w]
                yield pa.RecordBatch.from_arrays([pa.array([key[j] for j in keep], pa.int64()), pa.array([own[j].view(np.int64) for j in keep], pa.list_(pa.int64()))], ["key", "hashes"])

    def some(x: DataFrame) -> DataFrame:
        return F.broadcast(x) if few else x

    sets = docs.join(some(keys.where("id is not null")), "id").select("key", "text").mapInArrow(make, "key long, hashes array<long>")
    nameless = keys.where("id is null").select("key")
    if nameless.limit(1).count():
        every = docs.where("id is null").select(F.lit(None).cast("long").alias("key"), "text").mapInArrow(make, "key long, hashes array<long>")
        sets = sets.unionAll(every.join(some(nameless), "key", "left_semi"))
    sets = stash(sets.dropDuplicates(["key"]))
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).cast("long").alias("sizes"), F.size(F.array_intersect("x", "y")).cast("long").alias("shared"))
    return cut(both.where(down * F.col("shared") >= up * (F.col("sizes") - F.col("shared"))).select(F.col("a").alias("u"), F.col("b").alias("v")))
