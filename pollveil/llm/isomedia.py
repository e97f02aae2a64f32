"""Media columns: ISO base media containers.

`store` puts bytes losslessly into a container: raw grey 8 x 8 frames, a byte for each 8-bit sample, in chunks of
FRAMES_PER_CHUNK frames, each of which begins with a key frame. `inspect` walks the nested boxes of any such
container (64-bit sizes, boxes that reach to the end, unknown boxes), decodes the sample tables of all tracks, those of
movie fragments included, and gives codec, duration and the byte ranges of key frames; payloads are not decoded. What a
file claims is held against its size before anything is allocated. Containers hold no times, so that equal bytes give
equal files."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pollveil.llm.common import table

BLOCK, SIDE, FRAMES_PER_CHUNK, FRAMES_PER_SECOND = 64, 8, 32, 25
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
#: Fixed value: the unity matrix of track and movie headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
#: Boxes within boxes at most; real files have about eight.
MAX_DEPTH = 64
#: Rows of a batch that are held in a task at once.
STEP = 256


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of BLOCK."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def mux(payload: bytes) -> bytes:
    """A container of payload, whose length is a positive multiple of BLOCK."""
    frames = len(payload) // BLOCK
    chunks = -(-frames // FRAMES_PER_CHUNK)
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    entry = struct.pack(">6xHHH3IHHIIIH32sHh", 1, 0, 0, 0, 0, 0, SIDE, SIDE, 72 << 16, 72 << 16, 0, 1, b"", 40, -1)
    runs = [(1, FRAMES_PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != FRAMES_PER_CHUNK)
    keys = np.arange(1, frames + 1, FRAMES_PER_CHUNK, dtype=">u4")
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")

    def moov(at: int) -> bytes:
        where = at + np.arange(chunks, dtype=np.int64) * (BLOCK * FRAMES_PER_CHUNK)
        offsets = full_box(b"stco", struct.pack(">I", chunks), where.astype(">u4").tobytes()) if len(payload) < 1 << 31 else full_box(b"co64", struct.pack(">I", chunks), where.astype(">u8").tobytes())
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
            full_box(b"stts", struct.pack(">3I", 1, frames, 1)),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">2I", BLOCK, frames)),
            offsets,
        )
        dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">4IHH", 0, 0, FRAMES_PER_SECOND, frames, 0, 0)), full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = full_box(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, frames, 0, 0, 0, 0), MATRIX, struct.pack(">2I", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full_box(b"mvhd", struct.pack(">4IIH10x", 0, 0, FRAMES_PER_SECOND, frames, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    mdat = box(b"mdat", payload)
    return ftyp + moov(len(ftyp) + len(moov(0)) + len(mdat) - len(payload)) + mdat


def walk(data: memoryview) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, first byte of the box, first byte of the content, end) of each box, outer boxes first. A box that does not
    fit, and boxes nested too deeply, end the walk with ValueError."""
    open_ = [(0, len(data))]
    while open_:
        start, end = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box's long size is cut off")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, start, start + head, start + size
        open_.append((start + size, end))
        if kind in CONTAINERS:
            if len(open_) > MAX_DEPTH:
                raise ValueError("boxes are nested too deeply")
            open_.append((start + head, start + size))


@dataclass
class Track:
    number: int = 0
    handler: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, np.ndarray] = field(default_factory=dict)
    sample_size: int = 0
    n_samples: int = 0
    edits: list[tuple[int, int]] = field(default_factory=list)  # duration on the movie's scale, media time
    fragments: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # places, sizes, key or not

    def table_sizes(self) -> np.ndarray:
        return np.full(self.n_samples, self.sample_size, np.int64) if self.sample_size else self.tables.get(b"stsz", np.zeros(0)).astype(np.int64)

    def table_offsets(self) -> np.ndarray:
        """The first byte of each sample: chunk offsets, and sizes of the samples ahead in the chunk."""
        sizes, chunks = self.table_sizes(), self.tables.get(b"stco", np.zeros(0)).astype(np.int64)
        runs = self.tables.get(b"stsc", np.zeros((0, 3))).astype(np.int64)
        if not len(sizes):
            return np.zeros(0, np.int64)
        if not len(chunks) or not len(runs):
            raise ValueError("there are samples, but no chunks")
        until = np.append(runs[1:, 0], len(chunks) + 1)
        per_chunk = np.repeat(runs[:, 1], np.clip(until - runs[:, 0], 0, len(chunks)))[: len(chunks)]
        first = np.minimum(np.cumsum(per_chunk) - per_chunk, len(sizes))
        per_chunk = np.minimum(per_chunk, len(sizes) - first)  # not more than there are, whatever the table says
        chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
        if len(chunk) < len(sizes):
            raise ValueError("chunks hold fewer samples than there are sizes")
        before = np.cumsum(sizes) - sizes
        return chunks[chunk] + before - before[np.minimum(first, len(sizes) - 1)][chunk]

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bytes and sizes of all samples, and which are key frames; without a table of these every one is."""
        at, sizes = self.table_offsets(), self.table_sizes()
        keys = np.ones(len(at), bool)
        if b"stss" in self.tables:
            own = self.tables[b"stss"].astype(np.int64) - 1
            if len(own) and (own.min() < 0 or own.max() >= len(at)):
                raise ValueError("a key frame lies beyond the samples")
            keys[:] = False
            keys[own] = True
        return tuple(np.concatenate(x) for x in zip((at, sizes, keys), *self.fragments, strict=True))


def _media_header(data: memoryview, at: int) -> tuple[int, int]:
    return struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)


def tracks(data: memoryview) -> list[Track]:
    """All tracks of a file, with the samples of their tables and of movie fragments."""
    out: list[Track] = []
    defaults: dict[int, tuple[int, int, int]] = {}  # of a track's fragments: duration, size, flags
    current: Track | None = None
    moof = base = after = 0
    own = (0, 0, 0)

    def rows(at: int, end: int, kind: str, columns: int = 1, head: int = 8) -> np.ndarray:
        (n,) = struct.unpack_from(">I", data, at + head - 4)
        if at + head + n * np.dtype(kind).itemsize * columns > end:
            raise ValueError("a table does not fit its box")
        found = np.frombuffer(data, kind, n * columns, at + head)
        return found.reshape(-1, columns) if columns > 1 else found

    for kind, box_at, at, end in walk(data):
        box = data[:end]  # no field is read beyond its box
        if kind == b"trak":
            current = Track()
            out.append(current)
        elif kind == b"moof":
            moof = after = box_at
        elif kind == b"traf":
            current = None
        elif kind == b"trex":
            number, _, *values = struct.unpack_from(">5I", box, at + 4)
            defaults[number] = tuple(values)
        elif kind == b"tfhd":
            flags, number = struct.unpack_from(">II", box, at)
            flags &= 0xFFFFFF
            current = next((t for t in out if t.number == number), None)
            if current is None:
                raise ValueError("a fragment of no track")
            where, base = at + 8, moof if flags & 0x20000 else after
            if flags & 1:
                (base,), where = struct.unpack_from(">Q", box, where), where + 8
            where += 4 * bool(flags & 2)
            found = list(defaults.get(number, (0, 0, 0)))
            for k, bit in enumerate((8, 16, 32)):
                if flags & bit:
                    (found[k],), where = struct.unpack_from(">I", box, where), where + 4
            own, after = tuple(found), base
        elif current is None:
            continue
        elif kind == b"trun":
            flags, n = struct.unpack_from(">II", box, at)
            flags &= 0xFFFFFF
            where, begin, first = at + 8, after, None
            if flags & 1:
                (shift,), where = struct.unpack_from(">i", box, where), where + 4
                begin = base + shift
            if flags & 4:
                (first,), where = struct.unpack_from(">I", box, where), where + 4
            bits = [b for b in (0x100, 0x200, 0x400, 0x800) if flags & b]
            if where + 4 * n * len(bits) > end or not bits and n * max(1, own[1]) > len(data):
                raise ValueError("a run of samples does not fit")
            found = np.frombuffer(box, ">u4", n * len(bits), where).reshape(n, len(bits)).astype(np.int64)
            of = {b: found[:, i] for i, b in enumerate(bits)}
            sizes = of.get(0x200, np.full(n, own[1], np.int64))
            marks = of.get(0x400, np.full(n, own[2], np.int64)).copy()
            if first is not None and n:
                marks[0] = first
            current.fragments.append((begin + np.cumsum(sizes) - sizes, sizes, marks & 0x10000 == 0))
            current.duration += int(of.get(0x100, np.full(n, own[0], np.int64)).sum())
            after = begin + int(sizes.sum())
        elif kind == b"tkhd":
            (current.number,) = struct.unpack_from(">I", box, at + (20 if box[at] == 1 else 12))
        elif kind == b"mdhd":
            current.timescale, current.duration = _media_header(box, at)
        elif kind == b"hdlr":
            current.handler = bytes(box[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"elst":
            long = box[at] == 1
            current.edits = [(a, b) for a, b, _ in rows(at, end, ">u8,>i8,>u4" if long else ">u4,>i4,>u4").tolist()]
        elif kind == b"stsd" and end - at >= 16:
            current.codec = bytes(box[at + 12 : at + 16]).decode("latin-1")
            if current.handler == "vide" and end - at >= 44:
                current.width, current.height = struct.unpack_from(">HH", box, at + 40)
        elif kind == b"stsz":
            current.sample_size, current.n_samples = struct.unpack_from(">II", box, at + 4)
            if not current.sample_size:
                current.tables[kind] = rows(at, end, ">u4", head=12)
            elif current.sample_size * current.n_samples > len(data):
                raise ValueError("samples lie beyond the file")
        elif kind == b"stz2":
            width, current.n_samples = struct.unpack_from(">3xBI", box, at + 4)
            if width not in (4, 8, 16) or at + 12 + (current.n_samples * width + 7) // 8 > end:
                raise ValueError("a table does not fit its box")
            found = np.frombuffer(box, ">u2" if width == 16 else "u1", (current.n_samples * width + 7) // 8 // (2 if width == 16 else 1), at + 12)
            current.tables[b"stsz"] = np.stack([found >> 4, found & 15], axis=1).ravel()[: current.n_samples] if width == 4 else found
        elif kind == b"stco":
            current.tables[b"stco"] = rows(at, end, ">u4")
        elif kind == b"co64":
            current.tables[b"stco"] = rows(at, end, ">u8")
        elif kind == b"stsc":
            current.tables[kind] = rows(at, end, ">u4", 3)
        elif kind == b"stss":
            current.tables[kind] = rows(at, end, ">u4")
    return out


def read_samples(data: memoryview, at: np.ndarray, sizes: np.ndarray) -> Iterator[memoryview]:
    """The stored bytes of samples, neighbouring ones together."""
    if not len(at):
        return
    ends = at + sizes
    breaks = np.nonzero(at[1:] != ends[:-1])[0] + 1
    for a, b in zip(np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]]), strict=True):
        if at[a] < 0 or ends[b - 1] > len(data):
            raise ValueError("samples lie beyond the file")
        yield data[int(at[a]) : int(ends[b - 1])]


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8, however long, padded, in a container. Null counts as empty;
    repeated rows give equal rows, an empty table none; other columns are not looked at."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                some = batch.slice(i, STEP)
                raw = [b or b"" for b in some.column("data").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array([mux(pad(b)) for b in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("data"))
    return own.mapInArrow(write, f"doc_id {dict(own.dtypes)['doc_id']}, n_bytes long, media binary")


_RANGES, _EDITS = "array<struct<offset:long,size:long>>", "array<struct<duration:long,media_time:long>>"
FEATURES = f"codec string, width int, height int, n_frames long, duration_s double, keyframes {_RANGES}, payload_bytes long, payload_sha256 string, tail_crc32 long, tracks array<struct<track:long,handler:string,codec:string,n_frames:long,duration_s:double,keyframes:{_RANGES},edits:{_EDITS}>>, error string"


def features(media: bytes | None) -> dict:
    """Of the first video track with samples, else of the first track: codec, size, frames, duration, byte ranges of key
    frames, and digests of the stored bytes; of every track the same without digests, and its edit list. Null, what is
    no container, and what does not hold together: nulls, and the reason in `error`."""
    try:
        if media is None:
            raise ValueError("no media")
        data = memoryview(media)
        found = tracks(data)
        if not found:
            raise ValueError("no track")
        every = []
        for t in found:
            at, size, key = t.samples()
            if len(at) and (at.min() < 0 or (at + size).max() > len(data)):
                raise ValueError("samples lie beyond the file")
            seconds = t.duration / t.timescale if t.timescale else None
            every.append((t, at, size, {"track": t.number, "handler": t.handler, "codec": t.codec, "n_frames": len(at), "duration_s": seconds, "keyframes": [{"offset": a, "size": b} for a, b in zip(at[key].tolist(), size[key].tolist(), strict=True)], "edits": [{"duration": a, "media_time": b} for a, b in t.edits]}))
        t, at, size, own = next((x for x in every if x[0].handler == "vide" and len(x[1])), every[0])
        digest, n, tail = hashlib.sha256(), 0, b""
        for part in read_samples(data, at, size):
            digest.update(part)
            n, tail = n + len(part), (tail + bytes(part[-BLOCK:]))[-BLOCK:]
        return {k: own[k] for k in ("codec", "n_frames", "duration_s", "keyframes")} | {"width": t.width, "height": t.height, "payload_bytes": n, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "tracks": [x[3] for x in every], "error": None}
    except (ValueError, struct.error, KeyError, IndexError, OverflowError) as e:
        return {"error": str(e)[:200] or type(e).__name__}


def inspect(files: DataFrame, media: str = "media") -> DataFrame:
    """files without the media column, and with FEATURES, which replace columns of the same names. A row for each row:
    null, empty and broken media have nulls and an `error`; files of any length are read whole, one at a time; repeated
    rows get equal features; an empty table gives no rows."""
    new = T._parse_datatype_string(FEATURES)
    files = files.drop(*(n for n in new.fieldNames() if n != media))
    schema = T.StructType([f for f in files.schema.fields if f.name != media] + new.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
        edits = pa.list_(pa.struct([("duration", pa.int64()), ("media_time", pa.int64())]))
        track = pa.struct([("track", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("n_frames", pa.int64()), ("duration_s", pa.float64()), ("keyframes", ranges), ("edits", edits)])
        kinds = pa.schema([("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("n_frames", pa.int64()), ("duration_s", pa.float64()), ("keyframes", ranges), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("tracks", pa.list_(track)), ("error", pa.string())])
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                some = batch.slice(i, STEP)
                got = pa.RecordBatch.from_pylist([dict.fromkeys(kinds.names) | features(m.as_py()) for m in some.column(media)], kinds)
                rest = [n for n in some.schema.names if n != media]
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in rest), *got.columns], [*rest, *kinds.names])

    return files.mapInArrow(read, schema)


def op3_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = store(table(spark, sf_dir, "documents")).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    keys = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k.offset.cast("string"), k["size"].cast("string"))), ",")
    feature = F.concat(F.col("codec"), F.lit(" "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(" frames="), F.col("n_frames").cast("string"), F.lit(" seconds="), F.format_string("%.2f", "duration_s"), F.lit(" keys="), keys)
    return inspect(files).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec", "duration_s", "keyframes")
