"""Operators on documents: brute force, round trips, and the edges that every one must stand."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pollveil.llm import decontaminate, hmm, isomedia, langid, licenses, packing, queries, simhash, token_spans, urlfilter
from pollveil.llm.tokenize import default_path, tokenizer
from tests.llm.helpers import DOCUMENTS, EDGES, SF, documents


@pytest.fixture(scope="module")
def edges(spark):
    return documents(spark, EDGES).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, EDGES).where("false")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# op1


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g, seed=42).intdigest()
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(grams))


def plain_components(fps, radius=2):
    fps, root = sorted(set(fps)), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def check_groups(rows, text_of=None):
    fps = [int(r.fingerprint, 16) for r in rows]
    group = plain_components(fps)
    low = {}
    for r, f in zip(rows, fps, strict=True):
        if r.doc_id is not None:
            low[group[f]] = min(low.get(group[f], r.doc_id), r.doc_id)
    assert all(r.component_id == low.get(group[f]) for r, f in zip(rows, fps, strict=True))


def test_fingerprints_and_groups(spark, sample):
    rows = queries.QUERIES["op1_simhash_near_dedup"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in sample.collect()}
    assert len(rows) == len(texts)
    assert all(int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id]) and len(r.fingerprint) == 16 for r in rows)
    check_groups(rows)


def test_near_duplicates_at_the_edges(edges, nothing):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES)
    check_groups(rows)
    blank = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(blank) == 4 and {r.component_id for r in blank} == {1}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7]
    assert simhash.keep_one(nothing).count() == 0


def test_tree_finds_all_links_among_close_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 50)
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40)
    own = {int(s) for s in seeds}
    for s in seeds:  # balls and chains around each seed
        x = int(s)
        for _ in range(25):
            x ^= 1 << int(rng.integers(63))
            own.add(x)
    df = spark.createDataFrame([(x,) for x in own], "fp long")
    found = simhash.components(simhash.links(df)).collect()
    want = plain_components(own)
    got = {r.node: r.root for r in found}
    groups = defaultdict(set)
    for x in own:
        groups[want[x]].add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({got.get(x, x) for x in own})


def test_forest_keeps_links_of_earlier_batches():
    batches = [([3, 4], [2, 2]), ([3, 4], [1, 0])]
    assert simhash.forest(5, ((np.array(a), np.array(b)) for a, b in batches)).tolist() == [0] * 5


def test_forest_of_dense_clusters(monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = np.random.default_rng(5)
    for _ in range(20):
        centres = rng.integers(0, 1 << 63, 4)
        fps = np.unique([int(c) ^ sum(1 << int(b) for b in rng.choice(20, 3, replace=False)) for c in centres for _ in range(60)]).astype(np.uint64)
        root = simhash.forest(len(fps), simhash.near_pairs(fps, len(fps), 2))
        want = plain_components(fps.tolist())
        pairs = {(int(r), want[int(f)]) for r, f in zip(root, fps, strict=True)}
        assert len(pairs) == len({r for r, _ in pairs}) == len({w for _, w in pairs})


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1300)]
    rows = simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 1 for i in range(1, 61)}, **{i: 1000 for i in range(1000, 1300)}}


# tokens: op2, op9


def test_tokenizer_equals_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    tok = tokenizer(default_path())
    texts = ["", " ", "  a", "a  b", "a \n b\n", "x <|endoftext|> y", "it's 42 %$", "Ünï 漢字🙂", "a b c", "\n\n\nend"]
    for t in texts:
        assert tok.encode(t).tolist() == other.encode(t, add_special_tokens=False).ids, t


@given(st.text(alphabet=" \n\tab.'1é漢", max_size=12))
@settings(max_examples=300, deadline=None)
def test_tokenizer_on_white_space(text):
    tok = tokenizer(default_path())
    assert tok.encode(text).tolist() == tok._any.encode_ordinary(text)
    assert tok.n_bytes[tok.encode(text)].sum() == len(text.encode())


@given(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(0, 9), max_size=6))
@settings(max_examples=200, deadline=None)
def test_allocation_rules(sizes, cuts):
    total = sum(sizes)
    ends = np.array(sorted(min(c, total) for c in cuts) + [total])
    tokens = np.cumsum(sizes)
    for rule in token_spans.RULES:
        got = token_spans.allocate(tokens, ends, rule)
        want = [0.0] * len(ends)
        start = 0
        for end in tokens.tolist():
            shared = [max(0, min(e, end) - max(b, start)) for b, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            if rule == "split":
                want = [w + s / (end - start) for w, s in zip(want, shared, strict=True)]
            else:
                owners = [i for i, s in enumerate(shared) if s]
                own = owners[0] if rule == "first" else owners[-1] if rule == "last" else max(owners, key=lambda i: (shared[i], -i))
                want[own] += 1
            start = end
        assert np.allclose(got, want)


def test_section_counts(spark, sample, edges, nothing):
    tok = tokenizer(default_path())
    for docs in (sample.limit(60), edges):
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(r.text or "")
        rows = token_spans.token_counts(docs).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
        assert set(by) == set(texts)
        for doc, own in texts.items():
            assert sum(r.n_tokens for r in by[doc]) == sum(len(tok.encode(t)) for t in own)
            assert sorted((r.start_char, r.end_char) for r in by[doc] if r.section == 0) == sorted((0, len(t.split("\n")[0]) + ("\n" in t)) for t in own)
    assert token_spans.token_counts(nothing).count() == 0
    two = token_spans.token_counts(edges.where("doc_id = 8"), fields=("text", "source")).collect()
    assert [(r.field, r.section) for r in two] == [("text", 0), ("source", 0)] and sum(r.n_tokens for r in two) == two[0].doc_tokens
    with pytest.raises(ValueError, match="rule"):
        token_spans.token_counts(edges, rule="none")


def check_packing(rows, docs):
    """Every id once, in gapless windows; all but the last are full."""
    tok = tokenizer(default_path())
    want = Counter()
    for r in docs.collect():
        ids = np.append(tok.encode(r.text), packing.END_ID).astype("<u4")
        want[r.doc_id, len(ids)] += 1
    got, windows, starts = Counter(), defaultdict(list), Counter()
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
        starts[r.doc_id, r.doc_tokens] += r.start == 0
        windows[r.sequence_id].append(r)
    assert starts == want and all(got[k] == k[1] * n for k, n in want.items())
    for k, own in windows.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.WINDOW or k == max(windows)


def test_packing(spark, sample, edges, nothing):
    rows = queries.QUERIES["op9_mixture_packing"](spark, SF).collect()
    check_packing(rows, sample)
    tok = tokenizer(default_path())
    texts = {r.doc_id: r.text for r in sample.collect()}
    for r in rows:
        ids = np.append(tok.encode(texts[r.doc_id]), packing.END_ID).astype("<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    check_packing(packing.digests(packing.pack(edges)).collect(), edges)
    assert packing.pack(nothing).count() == 0


def turns_by_hand(units):
    """The round-robin as it runs: at each node two sides with a deficit, one quantum a turn."""
    if len(units) == 1:
        yield from [0] * units[0]
        return
    half = (1 << max(0, len(units) - 1).bit_length()) // 2
    left, right = turns_by_hand(units[:half]), turns_by_hand(units[half:])
    a, n = sum(units[:half]), sum(units)
    deficit = n // 2
    for _ in range(n):
        deficit += a
        if deficit >= n:
            deficit -= n
            yield next(left)
        else:
            yield half + next(right)


@given(st.lists(st.integers(0, 40), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_turns_against_the_round_robin_itself(units):
    served = list(turns_by_hand(units))
    at = [(j, s) for j, n in enumerate(units) for s in range(n)]
    got = packing.Tree(np.array(units, np.int64)).turn(np.array([j for j, _ in at], np.int64), np.array([s for _, s in at], np.int64))
    want = {}
    for t, j in enumerate(served):
        want[j, sum(1 for k in want if k[0] == j)] = t
    assert dict(zip(at, got.tolist(), strict=True)) == want


@given(st.integers(0, 1 << 40), st.integers(1, 1 << 40), st.integers(0, 1 << 40), st.integers(1, 1 << 40))
@settings(max_examples=300, deadline=None)
def test_muldiv(s, m, c, d):
    if s * m // d < 1 << 62:
        assert packing.muldiv(*(np.array([x], np.int64) for x in (s, m, c, d)))[0] == (s * m + c) // d


@pytest.mark.parametrize(("n_sources", "documents_each"), [(1, 30), (20, 15), (100, 6), (10_000, 1)])
def test_shares_at_every_window(n_sources, documents_each):
    """Every source within the stated bound of its share at every window, in long pieces; every token once."""
    rng = np.random.default_rng(n_sources)
    docs = [(s, int(n)) for s in range(n_sources) for n in rng.integers(1, 3000, documents_each)]
    totals = np.bincount([s for s, _ in docs], [n for _, n in docs]).astype(np.int64)
    own = np.nonzero(totals >= packing.QUANTUM)[0]
    queue = np.full(n_sources, len(own))
    queue[own] = np.arange(len(own))
    schedule = packing.Schedule(totals[own].tolist(), int(totals.sum() - totals[own].sum()))
    so_far: Counter = Counter()
    q, first, n = [], [], []
    for s, size in docs:
        key = int(queue[s])
        q.append(key)
        first.append(so_far[key])
        n.append(size)
        so_far[key] += size
    row, start, length, k, offset = schedule.pieces(*(np.array(x, np.int64) for x in (q, first, n)), packing.WINDOW)
    assert (np.bincount(row, length) == n).all() and (offset + length <= packing.WINDOW).all()
    at = k * packing.WINDOW + offset
    order = np.argsort(at)
    assert (at[order] == np.concatenate([[0], np.cumsum(length[order])[:-1]])).all()
    source = np.array([s for s, _ in docs])[row]
    bound = packing.QUANTUM * (1 + math.log2(len(own) + 1) / 2)
    windows = int(k.max()) + 1
    for s in range(0, n_sources, max(1, n_sources // 100)):
        mine = np.cumsum(np.bincount(k[source == s], length[source == s], minlength=windows))
        due = np.minimum(np.arange(1, windows + 1) * packing.WINDOW, totals.sum()) * totals[s] / totals.sum()
        extra = totals[s] if queue[s] == len(own) else 0
        assert (np.abs(mine - due) <= bound + extra).all()
    assert n_sources == 10_000 or np.median(length) >= 250


def test_packing_targets(spark, sample):
    rows = packing.pack(sample, targets={"src0": 3.0, "src1": 1.0}).drop("ids").collect()
    check_packing(rows, sample)
    assert {r.queue for r in rows} == {0, 1, 2}
    served, phase = Counter(), 6 * packing.WINDOW  # src0 lasts that long
    for r in rows:
        if r.sequence_id * packing.WINDOW < phase:
            served[r.queue] += r.length
    assert abs(served[0] - phase * 3 / 5) <= 2 * packing.QUANTUM and abs(served[1] - phase / 5) <= 2 * packing.QUANTUM
    with pytest.raises(ValueError, match="multiple"):
        packing.pack(sample, quantum=1000)


def test_packing_with_many_sources(spark, monkeypatch):
    docs = documents(spark, [(i, "some words " * (i % 50), "en", f"s{i % 300}") for i in range(900)])
    check_packing(packing.digests(packing.pack(docs)).collect(), docs)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    check_packing(packing.digests(packing.pack(docs)).collect(), docs)


# op3


def test_media_round_trip(spark, sample, edges, nothing):
    rows = {r.doc_id: r for r in queries.QUERIES["op3_iso_media"](spark, SF).collect()}
    for d in sample.collect():
        raw = (d.text or "").encode()
        stored = isomedia.pad(raw)
        r = rows[d.doc_id]
        assert len(stored) % 64 == 0 and stored
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]))
        file = isomedia.mux(stored)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        for k in r.keyframes:
            n = (k.offset - r.keyframes[0].offset) // 64
            assert file[k.offset : k.offset + k.size] == stored[64 * n : 64 * n + 64] and n % isomedia.FRAMES_PER_CHUNK == 0
    assert isomedia.inspect(isomedia.store(edges)).where("error is null").count() == len(EDGES)
    assert isomedia.inspect(isomedia.store(nothing)).count() == 0
    assert isomedia.inspect(edges.select("doc_id", "codec", F.lit(b"junk").alias("media"))).where("error is not null").count() == len(EDGES)


def test_boxes_of_other_writers():
    payload = isomedia.pad(b"x" * 5000)
    file = isomedia.mux(payload)
    # An unknown box in front moves all bytes: the tables must be moved as well, so place it behind.
    later = file + isomedia.box(b"free", b"1234")
    assert isomedia.features(later)["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    open_ended = bytearray(file)
    at = file.index(b"mdat") - 4
    open_ended[at : at + 4] = bytes(4)  # a box that reaches to the end
    assert isomedia.features(bytes(open_ended))["payload_bytes"] == len(payload)
    assert isomedia.features(file[:300])["error"] and isomedia.features(b"")["error"] and isomedia.features(None)["error"]
    t = isomedia.Track(sample_size=0, n_samples=5, tables={b"stsz": np.array([3, 4, 5, 6, 7]), b"stsc": np.array([[1, 2, 1], [2, 1, 1]]), b"stco": np.array([100, 200, 300, 400])})
    at, sizes, keys = t.samples()
    assert at.tolist() == [100, 103, 200, 300, 400] and sizes.tolist() == [3, 4, 5, 6, 7] and keys.all()


def moved(file, kind, content):
    """file with the content of its first box of a kind replaced by one of the same length."""
    at = file.index(kind) + 4
    return file[:at] + content + file[at + len(content) :]


def test_hostile_files():
    payload = isomedia.pad(b"x" * 5000)
    file = isomedia.mux(payload)
    trak = lambda *inner: isomedia.box(b"moov", isomedia.box(b"trak", *inner))
    nested = b""
    for _ in range(3000):
        nested = isomedia.box(b"moov", nested)
    bad = [
        trak(isomedia.box(b"mdhd")), nested, moved(file, b"stsz", struct.pack(">3I", 0, 1, 0xFFFFFFFF)), moved(file, b"stsz", struct.pack(">3I", 0, 0, 0xFFFFFFFF)),
        moved(file, b"stsc", struct.pack(">5I", 0, 1, 1, 1, 1)), moved(file, b"stco", struct.pack(">3I", 0, 1 << 30, 0)), moved(file, b"stss", struct.pack(">3I", 0, 1, 0)),
        trak(isomedia.full_box(b"stsz", struct.pack(">II", 0, 9))), trak(isomedia.full_box(b"stz2", struct.pack(">II", 3, 9))), isomedia.box(b"moof", isomedia.box(b"traf", isomedia.full_box(b"tfhd", struct.pack(">I", 7)))), b"\0" * 7, b"\0" * 8,
    ]
    for b in bad:
        began = time.perf_counter()
        assert isomedia.features(b)["error"], b[:60]
        assert time.perf_counter() - began < 1
    # Chunks that claim more samples than there are hold no more than there are.
    many = moved(file, b"stsc", struct.pack(">5I", 0, 2, 1, 32, 1) + struct.pack(">3I", 3, 0xFFFFFFFF, 1))
    assert isomedia.features(many)["payload_sha256"] == hashlib.sha256(payload).hexdigest()


@given(st.integers(0, 700), st.binary(min_size=1, max_size=4))
@settings(max_examples=300, deadline=1000)
def test_damaged_files_never_raise(at, noise):
    file = bytearray(isomedia.mux(isomedia.pad(b"y" * 3000)))
    file[at : at + len(noise)] = noise
    isomedia.features(bytes(file))
    isomedia.features(bytes(file[:at]))


def test_fragments_other_tracks_and_compact_sizes():
    def track(number, handler, *tables):
        stbl = isomedia.box(b"stbl", isomedia.full_box(b"stsd", struct.pack(">I", 1), isomedia.box(b"abcd", bytes(40))), *tables)
        return isomedia.box(b"trak", isomedia.full_box(b"tkhd", struct.pack(">5I", 0, 0, number, 0, 0)), isomedia.box(b"mdia", isomedia.full_box(b"mdhd", struct.pack(">5I", 0, 0, 10, 0, 0)), isomedia.full_box(b"hdlr", bytes(4), handler), isomedia.box(b"minf", stbl)))

    elst = isomedia.box(b"edts", isomedia.full_box(b"elst", struct.pack(">IIiI", 1, 50, -1, 0x10000)))
    sizes = isomedia.full_box(b"stz2", struct.pack(">II", 4, 3), bytes([0x12, 0x30]))
    sound = track(1, b"soun", sizes, isomedia.full_box(b"stsc", struct.pack(">4I", 1, 1, 3, 1)), isomedia.full_box(b"stco", struct.pack(">II", 1, 8)))
    trex = isomedia.box(b"mvex", isomedia.full_box(b"trex", struct.pack(">5I", 2, 1, 5, 4, 0x10000)))
    video = track(2, b"vide")
    video = isomedia.box(b"trak", video[8:], elst)
    head = isomedia.box(b"free", b"abcdef") + isomedia.box(b"moov", sound, video, trex)

    def fragment(shift):
        first = isomedia.full_box(b"trun", struct.pack(">IiI", 3, shift, 0), flags=0x5)  # default sizes; the first is a key frame
        second = isomedia.full_box(b"trun", struct.pack(">5I", 2, 3, 0x10000, 6, 0), flags=0x600)
        return isomedia.box(b"moof", isomedia.full_box(b"mfhd", struct.pack(">I", 1)), isomedia.box(b"traf", isomedia.full_box(b"tfhd", struct.pack(">I", 2), flags=0x20000), first, second))

    size = len(fragment(0))
    file = head + fragment(size + 8) + isomedia.box(b"mdat", bytes(range(21)))
    got = isomedia.features(file)
    begin = len(head) + size + 8
    assert got["error"] is None and got["n_frames"] == 5 and got["duration_s"] == 2.5 and got["payload_bytes"] == 21
    assert [(k["offset"] - begin, k["size"]) for k in got["keyframes"]] == [(0, 4), (15, 6)]
    assert got["payload_sha256"] == hashlib.sha256(bytes(range(21))).hexdigest()
    assert [(t["track"], t["handler"], t["n_frames"]) for t in got["tracks"]] == [(1, "soun", 3), (2, "vide", 5)]
    assert got["tracks"][0]["keyframes"] == [{"offset": 8, "size": 1}, {"offset": 9, "size": 2}, {"offset": 11, "size": 3}]
    assert got["tracks"][1]["edits"] == [{"duration": 50, "media_time": -1}]


# op4


def edits_within(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        prev, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(prev[j - 1] + (a != b), prev[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination_against_alignment_of_all(spark, sample):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(6).collect()]
    index = decontaminate.Index(list(range(len(items))), items)
    rng = np.random.default_rng(5)
    texts = [decontaminate.normal(r.text)[:400] for r in sample.limit(8).collect()]
    for n in range(16):
        item = list(decontaminate.normal(items[n % len(items)]))
        for _ in range(int(rng.integers(0, len(item) // 7))):
            j = int(rng.integers(len(item)))
            item[j : j + 1] = ["", "x", item[j] + "y"][int(rng.integers(3))]
        texts.append(texts[n % 8][:150] + " " + "".join(item) + " " + texts[n % 8][150:])
    for text in texts:
        got = {f.item: f.edits for f in index.find(text)}
        for n, item in enumerate(items):
            least = edits_within(decontaminate.normal(item), text)
            assert got.get(n) == (least if least <= index.k[n] else None)


@given(st.data())
@settings(max_examples=250, deadline=None)
def test_matches_are_those_of_plain_edit_distance(data):
    """Items of 10 to 300 characters in mixed scripts, edited; characters whose bytes in the filter are equal among them."""
    alphabet = data.draw(st.sampled_from(["ab ", "abcdefgh &\u0101", "αβγ漢字語 x", "\U0001f642é&\u0101z "]))
    text_of = lambda low, high: decontaminate.normal(data.draw(st.text(alphabet, min_size=low, max_size=high)))
    item = text_of(1, data.draw(st.sampled_from([12, 25, 45, 300])))
    own = list(item)
    for _ in range(data.draw(st.integers(0, len(item) // 9 + 1))):
        at = data.draw(st.integers(0, max(0, len(own) - 1)))
        own[at : at + 1] = data.draw(st.sampled_from(["", "x", "xy", alphabet[0]]))
    text = decontaminate.normal(text_of(0, 60) + data.draw(st.sampled_from(["", " "])) + "".join(own) + " " + text_of(0, 60))
    index = decontaminate.Index([1], [item])
    found = index.find(text)
    if not item:
        assert not found
        return
    k = max(0, len(item) // 10)
    assert index.k == [min(k, len(item) - 1)]
    if len(item) < decontaminate.WHOLE_WORDS:
        at = [m.start() for m in re.finditer(f"(?<!\\w)(?={re.escape(item)}(?!\\w))", text)]
        assert bool(found) == bool(at) and all(f.start in at for f in found)
        return
    least = edits_within(item, text)
    assert min((f.edits for f in found), default=None) == (least if least <= k else None)
    for f in found:
        assert edits_of(item, text[f.start : f.end]) == f.edits


def edits_of(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j - 1] + (x != y), prev[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_short_items_are_whole_words():
    index = decontaminate.Index([1, 2], ["yes", "a b"])
    assert index.find("my eyes hurt, xa b") == [] and [(f.item, f.start) for f in index.find("yes, say yes: a b")] == [(0, 0), (0, 9), (1, 14)]
    assert [decontaminate.budget(m) for m in (1, 9, 12, 20, 30, 300)] == [0, 0, 1, 2, 3, 30]


def test_decontamination_edges(spark, edges, nothing):
    items = spark.createDataFrame([(1, "The quick  brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "漢字"), (5, "one two")], "item_id long, text string")
    rows = decontaminate.contaminated(edges, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in rows) == {(7, 1): 2, (8, 1): 1, (None, 4): 1, (5, 5): 1}
    kept = decontaminate.keep_clean(edges, items)
    assert kept.columns == edges.columns and kept.count() == len(EDGES) - 5
    assert decontaminate.keep_clean(edges, items.where("false")).count() == len(EDGES)
    assert decontaminate.contaminated(edges, items.where("false")).count() == 0 == decontaminate.contaminated(nothing, items).count()


def test_decontamination_across_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 100)
    item = "a passage of some length that the benchmark holds, word by word"
    for n in range(0, 300, 7):
        text = "z" * n + item + "z" * 200
        assert [(f.start, f.end, f.edits) for f in decontaminate.Index([1], [item]).find(text)] == [(n, n + len(item), 0)]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 40)
    docs = spark.createDataFrame([(1, f"x {item} y")], "doc_id long, text string")
    items = spark.createDataFrame([(i, item[i:]) for i in range(4)], "item_id long, text string")
    assert sorted(r.item_id for r in decontaminate.contaminated(docs, items).collect()) == [0, 1, 2, 3]


# op6


def test_language_model_base_and_training(spark, sample):
    rows = queries.QUERIES["op6_hmm_language_model"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in sample.collect()}
    train = {d: t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1}
    count = Counter()
    for t in train.values():
        count.update([*hmm.words(t), hmm.END])
    n, v = sum(count.values()), len(count)
    for r in rows:
        own = [*hmm.words(texts[r.doc_id]), hmm.END]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(count[w] > 0 for w in own), n, r.doc_id not in train)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scaled_forward_is_the_sum_over_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    p = hmm.Parameters(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    docs = [np.array(d) for d in ([0, 3, 1, 2, 4], [2, 2, 1], [4])]
    for d, got in zip(docs, hmm.log_likelihoods(p, docs), strict=True):
        total = 0.0
        for path in product(range(3), repeat=len(d)):
            x = p.start[path[0]] * p.emit[d[0], path[0]]
            for a, b, w in zip(path, path[1:], d[1:], strict=False):
                x *= p.move[a, b] * p.emit[w, b]
            total += x
        assert math.isclose(got, math.log(total), rel_tol=1e-9)


def test_baum_welch_never_loses_likelihood():
    rng = np.random.default_rng(2)
    docs = sorted((rng.integers(0, 6, int(n)) for n in rng.integers(1, 30, 20)), key=lambda d: -len(d))
    p, last = hmm.first_parameters(np.ones(6), 3), -math.inf
    for _ in range(6):
        total = hmm.Parameters(np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3)))
        now = hmm.expect(p, docs, total)
        assert now >= last - 1e-9 and math.isclose(total.emit.sum(), sum(map(len, docs)), rel_tol=1e-9)
        last = now
        p = hmm.Parameters(total.start / total.start.sum(), total.move / total.move.sum(axis=1, keepdims=True), total.emit / total.emit.sum(axis=0))


def test_language_model_edges(edges, nothing, monkeypatch):
    monkeypatch.setattr(hmm, "WARM_ROUNDS", 1)
    monkeypatch.setattr(hmm, "ROUNDS", 1)
    own = edges.select("doc_id", "text", (F.coalesce(F.col("doc_id"), F.lit(0)) == 5).alias("held_out"))
    rows = hmm.score(own).collect()
    assert len(rows) == len(EDGES) and all(math.isfinite(r.score) for r in rows)
    assert sorted(r.n_tokens for r in rows)[:4] == [1, 1, 1, 1] and max(r.n_tokens for r in rows) == 80_001
    assert [r.n_known for r in rows if r.doc_id == 5] == [2]  # "two" was never seen
    unseen = hmm.score(own.withColumn("held_out", F.lit(True))).collect()
    assert len(unseen) == len(EDGES) and {r.n_known for r in unseen} == {0}
    assert hmm.score(own.where("false")).count() == 0


# op7


def test_url_filter_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cursor = con.execute(urlfilter.oracle())
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES["op7_bloom_url_filter"](spark, SF).select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(cursor.fetchall(), key=repr)


@pytest.mark.parametrize(("max_blocks", "max_listed"), [(0, 0), (1, 1 << 17), (1 << 17, 0)])
def test_url_filter_edges(spark, max_blocks, max_listed):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.example.COM/en/70?x=1#f"), (5, "https://www.bad.test/p/?utm_source=z"), (5, "https://www.bad.test/p/?utm_source=z"), (6, "http://bad.test/p?b=2&a=1"), (7, "http://good.test/p"), (8, "://net/de/"), (9, "http://evilnet/de/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "'x' as host", "1 as block", "'x' as listed")
    listed = spark.createDataFrame([("http://bad.test/p",), ("http://m.bad.test/p/?a=1&b=2",), (None,), ("http://bad.test/p",)], "url string")
    rows = urlfilter.judge(pages, listed, urlfilter.RULES, max_blocks=max_blocks, max_listed=max_listed).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id < 5 or r.page_id == 8) == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.com", "/en/70", "example.com/en/7", "allow"), (8, "net", "/de/", "net/de/", "allow"),
    ]
    assert sorted((r.page_id, r.verdict) for r in rows if r.page_id in (5, 6, 7, 9)) == [(5, "block"), (5, "block"), (6, "block"), (7, "allow"), (9, "allow")]
    assert urlfilter.judge(pages.where("false"), listed, urlfilter.RULES).count() == 0
    many = pages.sparkSession.range(3000).select(F.concat(F.lit("http://h.test/"), F.col("id").cast("string")).alias("url"), "id")
    got = urlfilter.judge(many.withColumnRenamed("id", "page_id"), many.where("id % 3 = 0"), urlfilter.RULES, max_blocks=max_blocks, max_listed=max_listed).collect()
    assert len(got) == 3000 and all(r.listed == (r.page_id % 3 == 0) for r in got)
    assert urlfilter.judge(pages, listed.where("false"), urlfilter.RULES).where("listed").count() == 0


# op8


def test_language_id_on_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    rows = queries.QUERIES["op8_ecoc_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def has_letter(text):
    return any(unicodedata.category(c).startswith("L") for c in text or "")


def test_language_id_edges(spark, edges, nothing):
    model = langid.fit(edges)
    assert model.languages == ["de", "en"]
    rows = langid.identify(edges, model).select("doc_id", "text", "language.*", "score").collect()  # `language` is replaced
    assert len(rows) == len(EDGES) and {r[-1] for r in rows} == {"x"}
    assert all((r.lang_pred == "und") == (not has_letter(r.text)) for r in rows)
    assert model.predict(["½ ½", "²", "①Ⅷ", "42", "_", "ª", "漢", "e"])[0][:5] == ["und"] * 5
    assert "und" not in model.predict(["ª", "漢", "e"])[0]
    kept = langid.keep_identified(edges)
    assert kept.columns == edges.columns and not kept.where("text is null or trim(text) = ''").count()
    assert langid.keep_identified(nothing).count() == 0
    none = langid.fit(edges.where("lang is null"))
    assert none.predict(["text", None])[0] == ["und", "und"]
    one = langid.fit(edges.where("lang = 'en'"))
    assert one.predict(["some text"])[0] == ["en"]
    unlabelled = langid.keep_identified(edges.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.count() == sum(has_letter(t) for _, t, *_ in EDGES) > 0


def test_every_language_is_learned(spark):
    """80 languages, each with an alphabet of its own but for a few letters."""
    texts = [(80 * k + i, " ".join(chr(0x4E00 + 40 * i + (7 * k + j) % 20) * 2 + "ab"[j % 2] for j in range(30)), f"l{i:02}", "s") for k in range(4) for i in range(80)]
    docs = documents(spark, texts)
    model = langid.fit(docs.where("doc_id < 240"))
    assert len(model.languages) == 80
    rows = langid.identify(docs.where("doc_id >= 240"), model).collect()
    assert sum(r.language.lang_pred == r.lang for r in rows) >= 78


def test_decoding_against_plain_loops(spark, sample):
    """Counts, log-odds, margins, losses, choice and flag, each by its definition."""
    train = [r for r in sample.limit(40).collect() if r.lang]
    model = langid.fit(sample.limit(40))
    grams = lambda t: [g for d in [langid.plain(t)] for i in range(len(d) - 2) for g in (d[i : i + 2], d[i : i + 3])]
    feature = lambda g: int.from_bytes(g, "big") if len(g) == 2 else (1 << 16) + ((int.from_bytes(g, "big") * 2654435761) % (1 << 32) >> 16)
    counts = defaultdict(Counter)
    for r in train:
        counts[r.lang].update(map(feature, grams(r.text)))
    assert model.languages == sorted(counts)
    p = lambda lang, f: (counts[lang][f] + 0.5) / (sum(counts[lang].values()) + 0.5 * langid.N_FEATURES)
    code = langid.code_matrix(len(counts))
    for r in sample.limit(3).collect():
        text = r.text[:300]
        own = Counter(map(feature, grams(text)))
        losses = [0.0] * len(counts)
        for b in range(code.shape[1]):
            sides = [[x for x, c in zip(model.languages, code[:, b], strict=True) if c == v] for v in (1, -1)]
            weight = lambda f: math.log(sum(p(x, f) for x in sides[0]) / len(sides[0])) - math.log(sum(p(x, f) for x in sides[1]) / len(sides[1]))  # noqa: B023, E731
            margin = sum(weight(f) * n for f, n in own.items()) / (sum(own.values()) / 2)
            for i in range(len(losses)):
                losses[i] += math.log1p(math.exp(-8.0 * margin * int(code[i, b])))
        ranked = sorted(losses)
        (name,), (score,), (close,) = model.predict([text])
        assert name == model.languages[losses.index(ranked[0])] and close == ((ranked[1] - ranked[0]) / code.shape[1] < langid.AMBIGUOUS)
        assert math.isclose(score, 1 / sum(math.exp(ranked[0] - x) for x in losses), rel_tol=1e-3)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12, 30])
def test_codewords_are_apart(n):
    m = langid.code_matrix(n).astype(int)
    d = [(m[i] != m[j]).sum() for i in range(n) for j in range(i)]
    assert min(d) >= max(1, m.shape[1] // 4) and (np.abs(m.sum(axis=0)) < n).all()


# op10


def test_license_base(spark, sample):
    rows = {r.doc_id: r for r in queries.QUERIES["op10_license_scan"](spark, SF).collect()}
    for d in sample.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
        at, labels = [], set()
        for phrase, label in licenses.BASE:
            own = phrase.split()
            here = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            at += here
            labels |= {label} if here else set()
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_scan_equals_sql(spark, tmp_path):
    con = duckdb.connect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [t for _, t, _ in licenses.TEMPLATES] * 2 + [f"x y, {t.title()}; {t.replace(' ', '-')} z" for _, t, _ in licenses.TEMPLATES] + [None, "", "license " * 500, "Ünder the Apache  License"]
    docs.unionAll(spark.createDataFrame([(5000 + i // 2, t) for i, t in enumerate(more)], "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(licenses.oracle())
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES["op10_license_scan"](spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(cursor.fetchall(), key=repr)
    assert {x for r in got for x in r.labels.split(",")} >= {name for name, _, _ in licenses.TEMPLATES}


def test_license_templates(spark, edges, nothing):
    texts = [
        "x Licensed under the Apache License, Version 2.0 y", "Apache License, Version 1.1", "This work is licensed under the GNU General Public License, version 3",
        "GNU Lesser General Public License, version 3", "version 3 license public general gnu the under licensed is work this", "Released under the MIT License. " * 3, "mit-license", "", None,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, "plain words here") for i in range(40)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(docs, licenses.TEMPLATES, licenses.BASE).collect()}
    assert [rows[i].labels for i in range(9)] == ["apache,apache-2.0", "apache", "gpl,gpl-3.0", "lgpl-3.0", "", "mit", "mit", "", ""]
    assert rows[5].n_base == 3 and (rows[5].first_word, rows[5].last_word) == (3, 13) and rows[0].score == 1.0 and rows[1].score == 0.0
    assert licenses.scan(edges, licenses.TEMPLATES, licenses.BASE).count() == len(EDGES)
    assert licenses.scan(nothing, licenses.TEMPLATES, licenses.BASE).count() == 0
    with pytest.raises(ValueError, match="not in its notice"):
        licenses.scan(docs, [("x", "a b c", "b a")], licenses.BASE)


def test_documents_schema(sample):
    assert dict(sample.dtypes).items() <= dict(f.replace("long", "bigint").split() for f in DOCUMENTS.split(", ")).items()
