"""ISO media containers: codec, duration and keyframe byte ranges from nested boxes, without decoding payloads.

`media_tracks` walks the boxes of each container, decodes the sample tables (stsz or stz2, stsc, stco or co64,
stts, ctts, stss) and the fragments (trex, tfhd, tfdt, trun), and yields a row for each track.  Only headers and tables
are looked at; payload bytes are never read beyond their box header.

Defined results: a null or empty container gives one row with the error `empty`; bytes that aren't a container, or
whose boxes contradict each other, give one row with their error and null fields, and never fail the job.  A track
without a sync table has only keyframes; a fragment's samples are keyframes unless their flags say otherwise.
Repeated rows give repeated rows.  A container with no track gives the error `no track`.  Extra columns of the input
are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.shared import small_batches

CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta", b"mfra"}


class BadContainer(ValueError):
    """Bytes that can't be read as an ISO media container."""


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, first byte, first byte of the body, past the last) of each box from start up to end."""
    at = start
    while at < end:
        if end - at < 8:
            raise BadContainer("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise BadContainer("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            body += 16
        if size < body - at or at + size > end:
            raise BadContainer(f"box {kind.decode('latin-1')} goes beyond what holds it")
        yield kind, at, body, at + size
        at += size


def _table(data: memoryview, at: int, end: int, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if n * size > end - at:
        raise BadContainer("a table is longer than its box")
    return np.frombuffer(data, dtype, n, at)


class Track:
    """What the boxes of one track say."""

    def __init__(self) -> None:
        self.id = 0
        self.kind = self.codec = ""
        self.scale = self.ticks = 0
        self.width: int | None = None
        self.height: int | None = None
        self.sizes = np.zeros(0, np.int64)
        self.chunks = np.zeros(0, np.int64)
        self.per_chunk = np.zeros((0, 3), np.int64)
        self.times = np.zeros((0, 2), np.int64)
        self.shifts: np.ndarray | None = None
        self.sync: np.ndarray | None = None
        self.defaults = (0, 0, 0)
        self.more: list[tuple[int, int, int, bool]] = []  # offset, size, time, key: of fragments
        self.clock = 0

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offset, size, presentation time, is a keyframe) of each sample."""
        n = len(self.sizes)
        offsets = np.zeros(n, np.int64)
        if n:
            if not len(self.per_chunk) or not len(self.chunks):
                raise BadContainer("samples without chunks")
            first = self.per_chunk[:, 0] - 1
            if first[0] != 0 or (np.diff(first) <= 0).any():
                raise BadContainer("the sample-to-chunk table isn't in order")
            runs = np.diff(np.append(np.minimum(first, len(self.chunks)), len(self.chunks)))
            counts = np.repeat(self.per_chunk[:, 1], runs)
            if counts.sum() < n or (counts < 0).any():
                raise BadContainer("fewer samples in chunks than sizes")
            before = np.concatenate([[0], np.cumsum(counts)])
            chunk = np.searchsorted(before, np.arange(n), "right") - 1
            passed = np.concatenate([[0], np.cumsum(self.sizes)])
            offsets = self.chunks[chunk] + passed[:n] - passed[before[chunk]]
        spans = np.repeat(self.times[:, 1], self.times[:, 0])[:n] if len(self.times) else np.zeros(0, np.int64)
        if len(spans) < n:
            raise BadContainer("fewer durations than samples")
        times = np.concatenate([[0], np.cumsum(spans)])[:n]
        if self.shifts is not None:
            shift = np.repeat(self.shifts[:, 1], self.shifts[:, 0])[:n]
            times = times + np.pad(shift, (0, n - len(shift)))
        key = np.ones(n, bool)
        if self.sync is not None:
            key[:] = False
            if len(self.sync) and (self.sync.min() < 1 or self.sync.max() > n):
                raise BadContainer("a sync sample that isn't there")
            key[self.sync - 1] = True
        if self.more:
            extra = np.array(self.more, np.int64)
            offsets, sizes = np.concatenate([offsets, extra[:, 0]]), np.concatenate([self.sizes, extra[:, 1]])
            return offsets, sizes, np.concatenate([times, extra[:, 2]]), np.concatenate([key, extra[:, 3] > 0])
        return offsets, self.sizes, times, key

    def duration(self) -> int:
        tables = int((self.times[:, 0] * self.times[:, 1]).sum()) if len(self.times) else 0
        return max(self.ticks, tables, self.clock)


def _u32(data: memoryview, at: int, end: int) -> int:
    if end - at < 4:
        raise BadContainer("a box is too short")
    return struct.unpack_from(">I", data, at)[0]


def _codec(data: memoryview, body: int, end: int, track: Track) -> None:
    if _u32(data, body + 4, end) < 1:
        raise BadContainer("no sample entry")
    for kind, _, entry, stop in boxes(data, body + 8, end):
        track.codec = kind.decode("latin-1")
        if track.kind == "vide" and stop - entry >= 78:
            track.width, track.height = struct.unpack_from(">HH", data, entry + 24)
            for inner, _, at, _ in boxes(data, entry + 78, stop):
                if inner == b"avcC":
                    track.codec += "." + bytes(data[at + 1 : at + 4]).hex()
        return


def _read_track(data: memoryview, start: int, end: int, track: Track) -> None:
    for kind, _, at, stop in boxes(data, start, end):
        if kind in CONTAINERS:
            _read_track(data, at, stop, track)
            continue
        if kind == b"tkhd":
            track.id = _u32(data, at + (20 if data[at] == 1 else 12), stop)
        elif kind == b"mdhd":
            wide = data[at] == 1
            track.scale = _u32(data, at + (20 if wide else 12), stop)
            track.ticks = struct.unpack_from(">Q" if wide else ">I", data, at + (24 if wide else 16))[0]
            if track.ticks in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF):
                track.ticks = 0
        elif kind == b"hdlr":
            track.kind = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd":
            _codec(data, at, stop, track)
        elif kind == b"stsz":
            size, n = _u32(data, at + 4, stop), _u32(data, at + 8, stop)
            if size and n > len(data):
                raise BadContainer("more samples than bytes")
            track.sizes = np.full(n, size, np.int64) if size else _table(data, at + 12, stop, n, ">u4").astype(np.int64)
        elif kind == b"stz2":
            bits, n = data[at + 7], _u32(data, at + 8, stop)
            if bits == 4:
                raw = _table(data, at + 12, stop, (n + 1) // 2, "u1")
                track.sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
            else:
                track.sizes = _table(data, at + 12, stop, n, {8: "u1", 16: ">u2"}.get(bits) or _no("field size")).astype(np.int64)
        elif kind == b"stco":
            track.chunks = _table(data, at + 8, stop, _u32(data, at + 4, stop), ">u4").astype(np.int64)
        elif kind == b"co64":
            track.chunks = _table(data, at + 8, stop, _u32(data, at + 4, stop), ">u8").astype(np.int64)
        elif kind == b"stsc":
            track.per_chunk = _table(data, at + 8, stop, 3 * _u32(data, at + 4, stop), ">u4").astype(np.int64).reshape(-1, 3)
        elif kind == b"stts":
            track.times = _table(data, at + 8, stop, 2 * _u32(data, at + 4, stop), ">u4").astype(np.int64).reshape(-1, 2)
            if track.times[:, 0].sum() > len(data):
                raise BadContainer("more samples than bytes")
        elif kind == b"ctts":
            track.shifts = _table(data, at + 8, stop, 2 * _u32(data, at + 4, stop), ">i4").astype(np.int64).reshape(-1, 2)
            if (track.shifts[:, 0] < 0).any() or track.shifts[:, 0].sum() > len(data):
                raise BadContainer("more samples than bytes")
        elif kind == b"stss":
            track.sync = _table(data, at + 8, stop, _u32(data, at + 4, stop), ">u4").astype(np.int64)


def _no(what: str):
    raise BadContainer(f"unknown {what}")


def _read_fragment(data: memoryview, moof: int, start: int, end: int, tracks: dict[int, Track]) -> None:
    for kind, _, at, stop in boxes(data, start, end):
        if kind != b"traf":
            continue
        track, base, fields, next_at = None, moof, (0, 0, 0), moof
        for inner, _, b, e in boxes(data, at, stop):
            flags = _u32(data, b, e) & 0xFFFFFF
            if inner == b"tfhd":
                track = tracks.get(_u32(data, b + 4, e)) or _no("track in a fragment")
                p, fields = b + 8, track.defaults
                if flags & 1:
                    base = struct.unpack_from(">Q", data, p)[0]
                    p += 8
                p += 4 * bool(flags & 2)
                own = list(fields)
                for i, bit in enumerate((8, 16, 32)):
                    if flags & bit:
                        own[i] = _u32(data, p, e)
                        p += 4
                fields, next_at = tuple(own), base
            elif inner == b"tfdt" and track:
                track.clock = struct.unpack_from(">Q" if data[b] == 1 else ">I", data, b + 4)[0]
            elif inner == b"trun" and track:
                n, p, offset = _u32(data, b + 4, e), b + 8, next_at
                if flags & 1:
                    offset = base + struct.unpack_from(">i", data, p)[0]
                    p += 4
                first_flags = None
                if flags & 4:
                    first_flags = _u32(data, p, e)
                    p += 4
                bits = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
                if n > len(data):
                    raise BadContainer("more samples than bytes")
                rows = _table(data, p, e, n * len(bits), ">u4").astype(np.int64).reshape(n, len(bits))
                column = {bit: rows[:, i].tolist() for i, bit in enumerate(bits)}
                for i in range(n):
                    span = column[0x100][i] if 0x100 in column else fields[0]
                    size = column[0x200][i] if 0x200 in column else fields[1]
                    said = column[0x400][i] if 0x400 in column else (first_flags if first_flags is not None and i == 0 else fields[2])
                    shift = column[0x800][i] if 0x800 in column else 0
                    shift -= (shift >> 31) << 32  # a signed field
                    track.more.append((offset, size, track.clock + shift, not said & 0x10000))
                    offset += size
                    track.clock += span
                next_at = offset


def read_container(raw: bytes) -> list[Track]:
    """The tracks of a container, in the order of their boxes."""
    data = memoryview(raw)
    tracks: list[Track] = []
    top = list(boxes(data, 0, len(data)))
    for kind, _, at, stop in top:
        if kind != b"moov":
            continue
        inner = list(boxes(data, at, stop))
        for k, _, a, s in inner:
            if k == b"trak":
                tracks.append(Track())
                _read_track(data, a, s, tracks[-1])
        for k, _, a, s in inner:
            if k == b"mvex":
                for kk, _, b, e in boxes(data, a, s):
                    if kk == b"trex":
                        for t in tracks:
                            if t.id == _u32(data, b + 4, e):
                                t.defaults = tuple(_u32(data, b + x, e) for x in (12, 16, 20))
    by_id = {t.id: t for t in tracks}
    for kind, first, at, stop in top:
        if kind == b"moof":
            _read_fragment(data, first, at, stop, by_id)
    return tracks


TRACKS = (
    "media_id long, track_id long, kind string, codec string, width int, height int, timescale long, duration_ticks long, duration_s double, n_samples int, "
    "keyframes array<struct<sample:int,time_ticks:long,offset:long,length:long>>, error string"
)
_KEYFRAME = pa.struct([("sample", pa.int32()), ("time_ticks", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), None, pa.string()]
_NAMES = ["media_id", "track_id", "kind", "codec", "width", "height", "timescale", "duration_ticks", "duration_s", "n_samples", "keyframes", "error"]


def media_tracks(media: DataFrame) -> DataFrame:
    """A row for each track of each container in (media_id, content)."""

    def flush(rows: list[tuple], keys: list[np.ndarray]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros((0, 4), np.int64)
        items = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(flat[:, i])) for i in (1, 2, 3))], fields=list(_KEYFRAME))
        listed = pa.ListArray.from_arrays(pa.array(ends), items)
        arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES[:10])] + [listed, pa.array(columns[10], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 4), np.int64)
        for batch in batches:
            ids, rows, keys = batch.column(0).to_pylist(), [], []
            for i, cell in enumerate(batch.column(1)):
                raw = cell.as_buffer()
                if raw is None or not raw.size:
                    rows.append((ids[i], *[None] * 9, "empty"))
                    keys.append(none)
                    continue
                try:
                    made = []
                    for t in read_container(raw):
                        offset, size, time, key = t.samples()
                        if len(offset) and (offset.min() < 0 or size.min() < 0 or (offset + size).max() > raw.size):
                            raise BadContainer("a sample lies outside the file")
                        at = np.flatnonzero(key)
                        ticks = t.duration()
                        made.append(((ids[i], t.id, t.kind, t.codec, t.width, t.height, t.scale, ticks, ticks / t.scale if t.scale else None, len(offset), None), np.stack([at + 1, time[at], offset[at], size[at]], 1)))
                    if not made:
                        raise BadContainer("no track")
                except (BadContainer, struct.error, IndexError, ValueError, OverflowError, RecursionError) as e:
                    made = [((ids[i], *[None] * 9, str(e)[:200]), none)]
                rows += [m[0] for m in made]
                keys += [m[1] for m in made]
                if len(rows) >= 5000:
                    yield flush(rows, keys)
                    rows, keys = [], []
            if rows:
                yield flush(rows, keys)

    return small_batches(media).select(F.col("media_id").cast("long"), "content").mapInArrow(run, TRACKS)


# Writing containers: the tables here hold no media, so queries and tests wrap texts as payloads.


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _entry(kind: str, codec: bytes) -> bytes:
    if kind == "vide":
        extra = box(b"avcC", bytes([1, 0x64, 0, 0x1F, 0xFF, 0xE0, 0])) if codec == b"avc1" else b""
        return box(codec, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 640, 360), bytes(50), extra)
    return box(codec, bytes(6), struct.pack(">H", 1), bytes(20))


def _header(track_id: int, kind: str, codec: bytes, scale: int, ticks: int, tables: bytes) -> bytes:
    return box(
        b"trak",
        full(b"tkhd", struct.pack(">IIIII", 0, 0, track_id, 0, ticks), bytes(60), flags=7),
        box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIII", 0, 0, scale, ticks), bytes(4)),
            full(b"hdlr", bytes(4), kind.encode(), bytes(13)),
            box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), _entry(kind, codec)), tables)),
        ),
    )


def _u32s(*values) -> bytes:
    return np.asarray(values, ">u4").tobytes()


VIDEO = (b"avc1", b"hvc1", b"av01", b"vp09")


def wrap(payload: bytes, seed: int, sample_bytes: int = 512, per_chunk: int = 4, every: int = 8) -> bytes:
    """A container whose video samples are the payload in pieces, with a keyframe in every `every` samples.

    seed chooses the codec and the form: chunk offsets of 32 or 64 bits, a table of sizes or fragments.
    """
    pieces = [len(payload[i : i + sample_bytes]) for i in range(0, len(payload), sample_bytes)]
    n, scale, span = len(pieces), 12_800, 512
    codec = VIDEO[seed % 4]
    start = box(b"ftyp", b"isom", bytes(4), b"isomiso6")
    if seed % 5 == 4:  # fragmented
        tables = b"".join(full(k, _u32s(*v)) for k, v in ((b"stts", [0]), (b"stsc", [0]), (b"stsz", [0, 0]), (b"stco", [0])))
        moov = box(b"moov", _header(1, "vide", codec, scale, 0, tables), box(b"mvex", full(b"trex", _u32s(1, 1, span, 0, 0x10000))))
        out, done = [start, moov], 0
        for i in range(0, n, every):
            part = pieces[i : i + every]
            make = lambda offset: box(b"moof", full(b"mfhd", _u32s(i)), box(b"traf", full(b"tfhd", _u32s(1), flags=0x20000), full(b"tfdt", _u32s(i * span)), full(b"trun", _u32s(len(part)), struct.pack(">i", offset), _u32s(0x2000000), _u32s(*part), flags=0x205)))  # noqa: B023, E731
            out += [make(len(make(0)) + 8), box(b"mdat", payload[done : done + sum(part)])]
            done += sum(part)
        return b"".join(out)
    chunks = list(range(0, n, per_chunk))
    wide = seed % 5 == 3
    sums = np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)

    def moov(base: int) -> bytes:
        at = base + sums[chunks] if chunks else np.zeros(0, np.int64)
        offsets = full(b"co64", _u32s(len(chunks)), at.astype(">u8").tobytes()) if wide else full(b"stco", _u32s(len(chunks)), at.astype(">u4").tobytes())
        groups = []
        if chunks:
            last = n - chunks[-1]
            groups = [(1, min(per_chunk, n), 1)] if len(chunks) > 1 or last == per_chunk else [(1, last, 1)]
            if len(chunks) > 1 and last != per_chunk:
                groups.append((len(chunks), last, 1))
        tables = b"".join(
            [
                full(b"stts", _u32s(1, n, span) if n else _u32s(0)),
                full(b"stss", _u32s(len(range(0, n, every)), *range(1, n + 1, every))),
                full(b"stsc", _u32s(len(groups), *(x for g in groups for x in g))),
                full(b"stsz", _u32s(0, n, *pieces)),
                offsets,
            ]
        )
        return box(b"moov", full(b"mvhd", bytes(96)), _header(1, "vide", codec, scale, n * span, tables))

    head = 16 if wide else 8
    mdat = (struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")) + payload
    if seed % 2:  # the tables come last
        return start + mdat + moov(len(start) + head)
    return start + moov(len(start) + len(moov(0)) + head) + mdat


def wrapped_texts(docs: DataFrame) -> DataFrame:
    """(media_id, content): each text as the payload of a container; a null text is null."""

    @F.arrow_udf("binary")
    def make(ids: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else wrap(t.encode(), abs(i or 0)) for i, t in zip(ids.to_pylist(), text.to_pylist())], pa.binary())

    ids = F.col("doc_id").cast("long")
    return docs.select(ids.alias("media_id"), make(ids, F.col("text")).alias("content"))
