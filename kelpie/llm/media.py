"""Media columns: payloads in ISO base media files, and what their boxes say.

`store` puts each payload into a file of one 8-bit sound track whose sample tables give units of 64 bytes, chunks and sync
units. `probe` walks the nested boxes of stored files, decodes the sample tables and gives codec, duration and the byte
ranges of keyframes; it looks into no payload. `payload_of` reads the payload back through the sample tables.

Cases: null text is empty and gives one unit of zeros; equal payloads give equal files; repeated rows stay; null ids stay
null; a file that isn't well formed gets null values and says why in column `fault`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import chunked, rows_of, stored

UNIT, UNITS_A_CHUNK, RATE = 64, 64, 8000
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
STORED = "doc_id long, n_bytes long, media binary"
PROBED = (
    "doc_id long, n_bytes long, codec string, timescale long, duration long, n_samples long, n_keyframes long, "
    "keyframes array<struct<first:long,last:long>>, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, "
    "tail_crc32 long, fault string"
)


def _box(kind: bytes, *body: bytes) -> bytes:
    content = b"".join(body)
    return struct.pack(">I4s", 8 + len(content), kind) + content if len(content) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(content)) + content


def _full(kind: bytes, *body: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *body)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """The bytes with zeros up to a positive multiple of the unit."""
    return data + b"\0" * (-len(data) % unit if data else unit)


def mux(payload: bytes) -> bytes:
    """An ISO media file that holds the payload as units of 8-bit sound, in chunks that begin with a sync unit."""
    units = len(payload) // UNIT
    chunks = -(-units // UNITS_A_CHUNK)
    duration = units * UNIT
    identity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def movie(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (UNIT * UNITS_A_CHUNK)
        wide = chunks > 0 and offsets[-1] >= 2**32
        runs = [(1, UNITS_A_CHUNK, 1)] if units >= UNITS_A_CHUNK else []
        if units % UNITS_A_CHUNK:
            runs.append((chunks, units % UNITS_A_CHUNK, 1))
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, UNIT)),
            _full(b"stss", struct.pack(">I", chunks), (1 + np.arange(chunks) * UNITS_A_CHUNK).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, units)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        references = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1")))
        media = _box(
            b"mdia",
            _box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0)),
            _full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"payload\0"),
            _box(b"minf", _full(b"smhd", b"\0" * 4), references, table),
        )
        track = _box(b"tkhd", b"\1\0\0\7", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), b"\0" * 8, struct.pack(">hhhh", 0, 0, 256, 0), identity, b"\0" * 8)
        return _box(b"moov", _box(b"mvhd", b"\1\0\0\0", struct.pack(">QQIQIH", 0, 0, RATE, duration, 0x10000, 256), b"\0" * 10, identity, b"\0" * 24, struct.pack(">I", 2)), _box(b"trak", track, media))

    data = _box(b"mdat", payload)
    inner = len(data) - len(payload)
    first = len(head) + len(movie(0)) + inner
    moov = movie(first)
    return head + moov + data if len(moov) + len(head) + inner == first else head + movie(len(head) + len(moov) + inner) + data


def boxes(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, start and end of the content of each box, parents before what is nested in them; a stack, so any depth will do."""
    open_: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while open_:
        start, stop, path = open_.pop()
        if start == stop:
            continue
        if stop - start < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        inner = start + 8
        if size == 1:
            if stop - start < 16:
                raise ValueError("a box is cut short")
            size, inner = struct.unpack_from(">Q", data, inner)[0], inner + 8
        elif size == 0:
            size = stop - start
        if size < inner - start or start + size > stop:
            raise ValueError("a box ends outside its parent")
        open_.append((start + size, stop, path))
        yield (*path[-8:], kind), inner, start + size  # the nearest parents say what a box is
        if kind in _PARENTS:
            open_.append((inner, start + size, (*path[-8:], kind)))


def _table(body: memoryview, kind: str, columns: int = 1, at: int = 4) -> np.ndarray:
    """The entries of a table whose count stands at that byte; they must lie in the box."""
    number = struct.unpack_from(">I", body, at)[0]
    if at + 4 + number * columns * np.dtype(kind).itemsize > len(body):
        raise ValueError("a table ends outside its box")
    return np.frombuffer(body, kind, number * columns, at + 4).astype(np.int64).reshape((-1, columns) if columns > 1 else -1)


def probe(data: bytes) -> list[dict]:
    """Codec, timescale, duration, and place and size of each sample of each track, and which are sync samples."""
    view, tracks = memoryview(data), []
    for path, start, stop in boxes(view):
        kind, body = path[-1], view[start:stop]
        if kind == b"trak":
            tracks.append({})
        if len(path) < 2 or not tracks:
            continue
        track = tracks[-1]
        if kind == b"mdhd":
            track["timescale"], duration = struct.unpack_from(">IQ", body, 20) if body[0] == 1 else struct.unpack_from(">II", body, 12)
            track["duration"] = None if duration == (2**64 - 1 if body[0] == 1 else 2**32 - 1) else duration  # all ones: unknown
            if (duration if track["duration"] is not None else 0) >= 2**63:
                raise ValueError("a duration is beyond all bounds")
        elif kind == b"stsd":
            track["codec"] = bytes(body[12:16]).decode("latin1")
        elif kind == b"stss":
            track["sync"] = _table(body, ">u4") - 1
        elif kind == b"stsz":
            size, number = struct.unpack_from(">II", body, 4)
            if size * number > len(data):
                raise ValueError("samples are larger than the file")
            track["sizes"] = np.full(number, size, np.int64) if size else _table(body, ">u4", at=8)
        elif kind in (b"stco", b"co64"):
            track["chunks"] = _table(body, ">u4" if kind == b"stco" else ">u8")
        elif kind == b"stsc":
            track["runs"] = _table(body, ">u4", 3)
        elif kind == b"stts":
            track["times"] = _table(body, ">u4", 2)
    for track in tracks:
        if missing := {"codec", "duration", "sizes", "chunks", "runs", "times"} - track.keys():
            raise ValueError(f"a track has no {', '.join(sorted(missing))}")
        chunks, runs, sizes = track["chunks"], track["runs"], track["sizes"]
        spans = np.diff(np.append(runs[:, 0] - 1, len(chunks)))
        if (spans < 0).any() or int((spans * runs[:, 1]).sum()) != len(sizes):
            raise ValueError("the sample tables don't agree")
        in_chunk = np.repeat(runs[:, 1], spans)
        if len(in_chunk) != len(chunks) or track["times"][:, 0].sum() != len(sizes):
            raise ValueError("the sample tables don't agree")
        before = np.cumsum(sizes) - sizes
        chunk = np.repeat(np.arange(len(chunks)), in_chunk)
        firsts = np.cumsum(in_chunk) - in_chunk
        track["places"] = chunks[chunk] + before - before[firsts[chunk]] if len(sizes) else before
        if len(sizes) and ((track["places"] > len(data) - sizes).any() or track["places"].min() < 0):
            raise ValueError("a sample ends outside the file")
        track["sync"] = track.get("sync", np.arange(len(sizes)))
        if len(track["sync"]) and (track["sync"].min() < 0 or track["sync"].max() >= len(sizes)):
            raise ValueError("a sync sample isn't there")
    return tracks


def payload_of(data: bytes, track: dict) -> bytes:
    """The bytes of a track's samples in order; neighbouring samples are read at once."""
    places, sizes = track["places"], track["sizes"]
    breaks = np.flatnonzero(places[1:] != places[:-1] + sizes[:-1]) + 1
    starts, stops = places[np.r_[0, breaks]], (places + sizes)[np.r_[breaks - 1, -1]]
    return b"".join(data[s:e] for s, e in zip(starts.tolist(), stops.tolist(), strict=True))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as a stored media file."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chunked(rows_of(batches, "doc_id", "data"), 64):
            ids, data = [i for i, _ in some], [x or b"" for _, x in some]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, data), pa.int64()), pa.array([mux(padded(x)) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")).mapInArrow(fill, STORED), "media")


def features(files: DataFrame) -> DataFrame:
    """What the boxes of column media say, and digests of the payload read back through them."""
    names = [x.split()[0] for x in PROBED.replace("array<struct<first:long,last:long>>", "list").split(", ")]

    def read(doc_id: int | None, n_bytes: int, data: bytes | None) -> tuple:
        if data is None:
            return (doc_id, n_bytes, *[None] * 11, "there is no file")
        stored_as = (len(data), hashlib.sha256(data).hexdigest())
        try:
            track = probe(data)[0]
            payload = payload_of(data, track)
        except (ValueError, IndexError, struct.error) as e:
            return (doc_id, n_bytes, None, None, None, None, None, None, *stored_as, None, None, None, str(e))
        keys = [{"first": s, "last": s + n - 1} for s, n in zip(track["places"][track["sync"]].tolist(), track["sizes"][track["sync"]].tolist(), strict=True)]
        return (doc_id, n_bytes, track["codec"], track.get("timescale"), track["duration"], len(track["sizes"]), len(keys), keys, *stored_as, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), None)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 4 + [pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))] + [pa.int64(), pa.string()] * 2 + [pa.int64(), pa.string()]
        for some in chunked(rows_of(batches, "doc_id", "n_bytes", "media"), 64):
            got = [read(*row) for row in some]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(look, PROBED)
