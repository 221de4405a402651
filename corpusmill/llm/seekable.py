"""Files of independent zstandard frames with a seek table behind them.

Layout: data frames; a skippable frame with the directory (which documents each frame holds);
a skippable frame with the seek table of the public seekable format (compressed size, plain
size and checksum of each frame), whose last 9 bytes are its footer. Any zstandard reader can
decompress the file; one that knows the tables reads single frames.

A data frame holds whole documents: their number, their ids, marks of null ids, their token
counts, then all their tokens.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import xxhash
import zstandard

# Fixed values of the seekable format.
SKIPPABLE_DIRECTORY = 0x184D2A5D
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

DIRECTORY = np.dtype([("first", "<i8"), ("last", "<i8"), ("ids", "<i8"), ("docs", "<i8"), ("tokens", "<i8")])
SEEK = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])


class Document(NamedTuple):
    """A document as read back; ``start`` counts the file's tokens before it."""

    doc_id: int | None
    start: int
    tokens: bytes


def _checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class Writer:
    """Adds documents in order; memory holds one frame and the tables.

    A frame closes when its tokens reach ``frame_bytes``; a longer document fills a frame of
    its own. ``width`` is the bytes of a token, 2 for vocabularies up to 65,536.
    """

    def __init__(self, out: BinaryIO, width: int = 4, frame_bytes: int = 1 << 20, level: int = 3) -> None:
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.seek: list[tuple] = []
        self.directory: list[tuple] = []
        self.docs = self.tokens = self.bytes = 0
        self._clear()

    def _clear(self) -> None:
        self.ids: list[int | None] = []
        self.pieces: list[bytes] = []
        self.waiting = 0

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        """A document; ``tokens`` are little-endian unsigned 32-bit ids."""
        if self.width == 2:
            tokens = np.frombuffer(tokens, "<u4").astype("<u2").tobytes()
        if self.waiting and self.waiting + len(tokens) > self.frame_bytes:
            self._close_frame()
        self.ids.append(doc_id)
        self.pieces.append(tokens)
        self.waiting += len(tokens)

    def _close_frame(self) -> None:
        known = [i for i in self.ids if i is not None]
        counts = np.array([len(p) // self.width for p in self.pieces], "<i8")
        head = struct.pack("<IB", len(self.ids), self.width)
        ids = np.array([i or 0 for i in self.ids], "<i8").tobytes()
        nulls = bytes(i is None for i in self.ids)
        plain = b"".join([head, ids, nulls, counts.tobytes(), *self.pieces])
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        tokens = int(counts.sum())
        self.seek.append((len(packed), len(plain), _checksum(plain)))
        self.directory.append((min(known, default=0), max(known, default=-1), len(known), len(self.ids), tokens))
        self.docs, self.tokens, self.bytes = self.docs + len(self.ids), self.tokens + tokens, self.bytes + len(packed)
        self._clear()

    def close(self) -> None:
        """Writes the tables; the file itself stays open."""
        if self.ids:
            self._close_frame()
        directory = np.array(self.directory, DIRECTORY).tobytes()
        seek = np.array(self.seek, SEEK).tobytes() + struct.pack("<IBI", len(self.seek), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        for magic, table in ((SKIPPABLE_DIRECTORY, directory), (SKIPPABLE_SEEK_TABLE, seek)):
            self.out.write(struct.pack("<II", magic, len(table)) + table)
            self.bytes += 8 + len(table)


class Reader:
    """Reads the tables from the end of a file, then only the frames it is asked for.

    ``fetch(offset, length)`` returns bytes of the file, whose length is ``size``.
    """

    def __init__(self, fetch, size: int) -> None:
        self.fetch = fetch
        count, flags, magic = struct.unpack("<IBI", fetch(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        seek_bytes, directory_bytes = count * SEEK.itemsize + 9, count * DIRECTORY.itemsize
        start = size - seek_bytes - 8 - directory_bytes - 8
        tables = fetch(start, size - start)
        heads = struct.unpack_from("<II", tables), struct.unpack_from("<II", tables, 8 + directory_bytes)
        if heads != ((SKIPPABLE_DIRECTORY, directory_bytes), (SKIPPABLE_SEEK_TABLE, seek_bytes)):
            raise ValueError("tables of the file do not fit its footer")
        self.directory = np.frombuffer(tables, DIRECTORY, count, 8)
        self.seek = np.frombuffer(tables, SEEK, count, 16 + directory_bytes)
        self.offsets = np.concatenate([[0], np.cumsum(self.seek["packed"].astype(np.int64))])
        self.starts = np.concatenate([[0], np.cumsum(self.directory["tokens"])])
        if self.offsets[-1] != start:
            raise ValueError("frames of the file do not fit its seek table")
        self.zstd = zstandard.ZstdDecompressor()
        self.frames_read = 0

    def frame(self, k: int) -> Iterator[Document]:
        """Documents of one frame, checked against its checksum."""
        plain = self.zstd.decompress(self.fetch(int(self.offsets[k]), int(self.seek["packed"][k])))
        self.frames_read += 1
        if len(plain) != self.seek["plain"][k] or _checksum(plain) != self.seek["checksum"][k]:
            raise ValueError(f"frame {k} does not have its checksum")
        count, width = struct.unpack_from("<IB", plain)
        ids = np.frombuffer(plain, "<i8", count, 5)
        nulls = np.frombuffer(plain, "u1", count, 5 + 8 * count)
        counts = np.frombuffer(plain, "<i8", count, 5 + 9 * count)
        at, start = 5 + 17 * count, int(self.starts[k])
        for doc_id, null, n in zip(ids.tolist(), nulls.tolist(), counts.tolist()):
            tokens = plain[at:at + n * width]
            if width == 2:
                tokens = np.frombuffer(tokens, "<u2").astype("<u4").tobytes()
            yield Document(None if null else doc_id, start, tokens)
            at, start = at + n * width, start + n

    def documents(self, doc_ids: set[int] | None = None) -> Iterator[Document]:
        """All documents, or those of ``doc_ids`` from the frames that can hold them."""
        if doc_ids is None:
            for k in range(len(self.seek)):
                yield from self.frame(k)
            return
        wanted = np.array(sorted(doc_ids), "<i8")
        low = np.searchsorted(wanted, self.directory["first"], "left")
        high = np.searchsorted(wanted, self.directory["last"], "right")
        for k in np.flatnonzero(low < high).tolist():
            yield from (d for d in self.frame(k) if d.doc_id in doc_ids)
