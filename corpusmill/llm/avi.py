"""Media columns: texts as motion-JPEG AVI files, read back into timed clips."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.jpeg import MCU, decode_frames, encode_frames, luma, payload_of, shape_of

FRAME_MCUS, FPS, BINS, GROUP = 16, 25, 32, 1 << 20
CLIPS = "array<struct<first:int,last:int,start:double,end:double,luma:double>>"


def padded(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of 192."""
    return raw + b" " * (-len(raw) % MCU or MCU * (not raw))


def frames_of(payload: bytes) -> list[bytes]:
    """Equal frames; the last is filled up with spaces."""
    size = MCU * min(FRAME_MCUS, len(payload) // MCU)
    cut = [payload[i : i + size] for i in range(0, len(payload), size)]
    cut[-1] = cut[-1].ljust(size, b" ")
    return cut


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(jpegs: list[bytes], width: int, height: int, payload_bytes: int) -> bytes:
    """RIFF file with one video stream, its index, and the payload's length as a comment."""
    n, largest = len(jpegs), max(map(len, jpegs))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", str(payload_bytes).encode()))
    at, index, frames = 4, [], []
    for j in jpegs:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        frames.append(_chunk(b"00dc", j))
        at += len(frames[-1])
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", b"movi" + b"".join(frames)) + _chunk(b"idx1", b"".join(index)))


def read_avi(raw: bytes) -> tuple[list[bytes], float, int | None]:
    """Frames in index order, seconds per frame, and the payload's length if there is one."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
            if name == b"LIST":
                found[raw[at + 8 : at + 12]] = (at + 8, size)
                if raw[at + 8 : at + 12] != b"movi":
                    walk(at + 12, at + 8 + size)
            else:
                found.setdefault(name, (at + 8, size))
            at += 8 + size + size % 2

    walk(12, 8 + struct.unpack_from("<I", raw, 4)[0])
    at, size = found[b"idx1"]
    entries = [struct.unpack_from("<4sIII", raw, at + i) for i in range(0, size, 16)]
    base = found[b"movi"][0]
    if entries and raw[base + entries[0][2] : base + entries[0][2] + 4] != entries[0][0]:
        base = 0  # some writers count from the start of the file
    frames = [raw[base + o + 8 : base + o + 8 + n] for name, _, o, n in entries if name[2:] in (b"dc", b"db")]
    comment = found.get(b"ICMT")
    micro = struct.unpack_from("<I", raw, found[b"avih"][0])[0]
    return frames, micro / 1e6, int(raw[comment[0] : comment[0] + comment[1]].rstrip(b"\0")) if comment else None


def shots(histograms: np.ndarray, *, window: int = 8, spread: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """(first, last) frame of each shot.

    A shot ends where the histograms of neighbouring frames differ by at least ``least`` of
    their pixels and by more than the mean and ``spread`` deviations of the last
    ``window`` differences inside the shot.
    """
    pixels = max(int(histograms[0].sum()), 1)
    steps = np.abs(np.diff(histograms.astype(np.int64), axis=0)).sum(axis=1) / (2 * pixels)
    found, first, recent = [], 0, []
    for i, step in enumerate(steps.tolist(), 1):
        mean = sum(recent) / len(recent) if recent else 0.0
        deviation = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if step >= least and recent and step > mean + spread * deviation:
            found.append((first, i - 1))
            first, recent = i, []
        else:
            recent = [*recent[1 - window :], step]
    return [*found, (first, len(histograms) - 1)]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring items of about GROUP bytes together."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > GROUP:
            yield first, i
            first, total = i, 0
        total += n
    yield first, len(sizes)


def _each(frames: list[bytes], work) -> Iterator:
    for a, b in _groups([len(f) for f in frames]):
        yield from work(frames[a:b])


def _media(texts: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """AVI file of every text."""
    cut = [frames_of(padded(t)) for t in texts]
    jpegs = _each([f for fs in cut for f in fs], encode_frames)
    for text, frames in zip(texts, cut):
        width, height = shape_of(len(frames[0]) // MCU)
        yield write_avi([next(jpegs) for _ in frames], width, height, len(padded(text)))


def _views(media: list[bytes]) -> Iterator[tuple[bytes, list[tuple]]]:
    """Payload and clips of every file."""
    opened = [read_avi(m) for m in media]

    def views(jpegs: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, float]]:
        decoded = decode_frames(jpegs)
        pixels = np.split(np.concatenate([luma(c, q[0]) for _, _, c, q in decoded]), np.cumsum([len(c) for _, _, c, _ in decoded])[:-1])
        for (_, _, c, _), p in zip(decoded, pixels):
            yield payload_of(c), np.bincount(p.reshape(-1) >> 3, minlength=BINS), float(p.mean(dtype=np.float64))

    seen = _each([f for frames, *_ in opened for f in frames], views)
    for frames, seconds, length in opened:
        own = [next(seen) for _ in frames]
        clips = [(a, b, round(a * seconds, 6), round((b + 1) * seconds, 6), round(sum(x[2] for x in own[a : b + 1]) / (b + 1 - a), 3)) for a, b in shots(np.array([x[1] for x in own]))]
        yield b"".join(x[0] for x in own)[:length], clips


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, with_media: bool = False) -> DataFrame:
    """Per row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature and clips; with_media adds the file itself.

    A text's bytes, padded with spaces to a multiple of 192, are the quantised
    coefficients of baseline JPEG frames, 192 to a unit, in an AVI file. That file is then
    read by its RIFF index, decoded, and cut into shots; payload columns come from the
    decoded frames. ``feature`` lists the clips as first-last@mean luma.

    Null and empty texts are one frame of 192 spaces; rows are handled one by one, so
    null and repeated ids don't matter. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips " + CLIPS
    fields += ", media binary" * with_media

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("luma", pa.float64())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip, pa.binary()][: 8 + with_media]
        names = [f.split()[0] for f in ("id", *fields.split(" array")[0].split(", "))] + ["media"] * with_media
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                ids, column = batch.column("id").slice(lo, 512), batch.column("text").slice(lo, 512)
                texts = [(x or "").encode("utf-8", "replace") for x in column.to_pylist()]
                rows = []
                for a, b in _groups([len(t) for t in texts]):
                    media = list(_media(texts[a:b]))
                    for text, file, (payload, clips) in zip(texts[a:b], media, _views(media)):
                        rows.append((
                            len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(),
                            "|".join(f"{c[0]}-{c[1]}@{c[4]:.3f}" for c in clips), [dict(zip(("first", "last", "start", "end", "luma"), c)) for c in clips], file)[: 8 + with_media])
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tasks, f"id {kind.simpleString()}, {fields}")
    return found.withColumnRenamed("id", id_col)
