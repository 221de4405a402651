"""Baseline JPEG frames whose quantised coefficients are given bytes, and their decoding.

Frames are encoded and decoded many at a time: restart intervals are independent, so
the decoder reads one symbol of every interval in each step.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

MCU = 192  # three components of one 8x8 block
# Fixed values of the format: the order in which a block's coefficients are stored.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _codes() -> np.ndarray:
    """Nine bits per byte: a size code of 9 - s bits, then s bits of the coefficient.

    A byte is a coefficient from -128 to 128 that is never 0, so each block holds 64 of
    them without runs, and all sizes s from 1 to 8 have one code.
    """
    out = np.zeros(256, np.uint16)
    for byte in range(256):
        value = byte - 128 if byte < 128 else byte - 127
        size = abs(value).bit_length()
        ones = ((1 << (8 - size)) - 1) << 1
        out[byte] = ones << size | (value if value > 0 else value + (1 << size) - 1)
    return out


CODES = _codes()
TABLE = bytes([1] * 8 + [0] * 8 + list(range(8, 0, -1)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(64)
def frame_header(width: int, height: int) -> bytes:
    parts = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))
    return (
        b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, parts) + _segment(0xC4, b"\x00" + TABLE)
        + _segment(0xC4, b"\x10" + TABLE) + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0"))


def shape_of(mcus: int) -> tuple[int, int]:
    """Width and height of a frame of so many units: up to four a row."""
    across = 4 if mcus % 4 == 0 else mcus
    return 8 * across, 8 * (mcus // across)


def encode_frames(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload, whose length is a multiple of 192."""
    counts = np.array([len(p) // MCU for p in payloads])
    v = CODES[np.frombuffer(b"".join(payloads), np.uint8)].reshape(-1, 8)
    packed = np.empty((len(v), 9), np.uint8)
    packed[:, 0] = v[:, 0] >> 1
    for i in range(1, 8):
        packed[:, i] = (v[:, i - 1] << (8 - i)) | (v[:, i] >> (i + 1))
    packed[:, 8] = v[:, 7]
    data = np.empty((int(counts.sum()), 218), np.uint8)
    data[:, :216] = packed.reshape(len(data), 216)
    data[:, 216] = 0xFF
    last = np.cumsum(counts)
    data[:, 217] = 0xD0 + (np.arange(len(data)) - np.repeat(last - counts, counts)) % 8
    data[last - 1, 217] = 0xD9
    full = data == 0xFF
    full[:, 216:] = False
    stuffed = np.flatnonzero(full)
    flat = np.insert(data.reshape(-1), stuffed + 1, 0).tobytes()
    ends = last * 218 + np.searchsorted(stuffed, last * 218)
    return [frame_header(*shape_of(int(n))) + flat[a:b] for n, a, b in zip(counts, [0, *ends[:-1]], ends)]


@lru_cache(64)
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol by the next 16 bits; length 0 where there is no code."""
    lengths, symbols = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            low = code << (16 - length)
            lengths[low : low + (1 << (16 - length))] = length
            symbols[low : low + (1 << (16 - length))] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return lengths, symbols


@lru_cache(1024)
def _parse_header(head: bytes) -> tuple:
    """Width, height, restart interval, and per component its quantisation and Huffman tables."""
    at, quant, huff, interval, frame, scan = 2, {}, {}, 0, None, None
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisation tables belong to no baseline frame")
                quant[body[0] & 15], body = body[1:65], body[65:]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huff[body[0]], body = body[1:n], body[n:]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = (width, height, [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(n)])
        elif marker in range(0xC1, 0xD0) and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
    if frame is None or scan is None or any(c[1] != 0x11 for c in frame[2]) or len(scan) != len(frame[2]):
        raise ValueError("a frame needs one scan of components without subsampling")
    tables = {c: t for c, t in scan}
    return frame[0], frame[1], interval, tuple((quant[q], huff[tables[c] >> 4], huff[16 | tables[c] & 15]) for c, _, q in frame[2])


def _split(jpeg: bytes) -> tuple[tuple, bytes]:
    at = 2
    while jpeg[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    return _parse_header(jpeg[:at]), jpeg[at:]


def decode_frames(jpegs: list[bytes]) -> list[tuple[int, int, np.ndarray, tuple]]:
    """Per file its width, height, quantised coefficients (units, components, 64) in
    stored order, and the components' quantisation tables.
    """
    split = [_split(j) for j in jpegs]
    out: list = [None] * len(jpegs)
    for tables in {s[0][3] for s in split}:
        own = [i for i, s in enumerate(split) if s[0][3] == tables]
        units = np.array([-(-split[i][0][0] // 8) * -(-split[i][0][1] // 8) for i in own])
        interval = np.array([split[i][0][2] or u for i, u in zip(own, units)])
        coefficients = _decode([split[i][1] for i in own], units, interval, tables)
        for i, a, b in zip(own, np.cumsum(units) - units, np.cumsum(units)):
            out[i] = (split[i][0][0], split[i][0][1], coefficients[a:b], tuple(t[0] for t in tables))
    return out


def _decode(scans: list[bytes], units: np.ndarray, interval: np.ndarray, tables: tuple) -> np.ndarray:
    raw = np.frombuffer(b"".join(scans) + b"\0" * 8, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD9))
    keep = np.ones(len(raw), bool)
    keep[1:][(raw[:-1] == 0xFF) & (raw[1:] == 0)] = False
    keep[marks], keep[marks + 1] = False, False
    moved = np.concatenate([[0], np.cumsum(keep)])
    data = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
    word = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    lanes = -(-units // interval)  # restart intervals of each frame
    if len(marks) != lanes.sum():
        raise ValueError("a frame's restart markers don't agree with its size")
    pos = moved[np.concatenate([[0], marks[:-1] + 2])].astype(np.int64) * 8
    number = np.arange(len(pos)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    per = np.repeat(interval, lanes)
    count = np.minimum(per, np.repeat(units, lanes) - number * per) * len(tables)  # blocks
    base = (np.repeat(np.cumsum(units) - units, lanes) + number * per) * len(tables)
    out = np.zeros((int(units.sum()) * len(tables), 64), np.int32)
    before = np.zeros((len(tables), len(pos)), np.int64)
    looked = [[_lookup(t) for t in pair[1:]] for pair in tables]

    def peek(at: np.ndarray) -> np.ndarray:
        return (word[at >> 3].astype(np.int64) << (at & 7)) & 0xFFFFFFFF

    def symbol(at: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and position after it."""
        code = peek(at) >> 16
        if not (length := table[0][code]).all():
            raise ValueError("a frame holds an unknown code")
        return table[1][code], at + length

    def value(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        bits = peek(at) >> (32 - size)
        return np.where(bits >> np.maximum(size - 1, 0) == 1, bits, bits - (1 << size) + 1) * (size > 0)

    for block in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > block)
        c, row, at = block % len(tables), base[live] + block, pos[live]
        size, at = symbol(at, looked[c][0])
        before[c, live] += value(at, size)
        at = at + size
        out[row, 0] = before[c, live]
        k, busy = np.ones(len(live), np.int64), np.arange(len(live))
        while len(busy):
            found, here = symbol(at[busy], looked[c][1])
            run, size = found >> 4, found & 15
            k[busy] += run
            put = size > 0
            if (k[busy[put]] > 63).any():
                raise ValueError("a block holds too many coefficients")
            out[row[busy[put]], k[busy[put]]] = value(here, size)[put]
            at[busy] = here + size
            k[busy] = np.where(put | (run == 15), k[busy] + 1, 64)  # 0x00 ends the block
            busy = busy[k[busy] < 64]
        pos[live] = at
    return out.reshape(-1, len(tables), 64)


def payload_of(coefficients: np.ndarray) -> bytes:
    """The bytes that encode_frames stored."""
    return np.where(coefficients < 0, coefficients + 128, coefficients + 127).astype(np.uint8).tobytes()


def _basis() -> np.ndarray:
    """Cosine basis by stored coefficient and pixel, in 4096ths, whole numbers."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.rint(4096 * np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG])


BASIS = _basis()


def luma(coefficients: np.ndarray, quant: bytes) -> np.ndarray:
    """Pixels 0 to 255 of the first component, a row of 64 per unit.

    Sums of whole numbers, so they are exact however the rows are grouped.
    """
    pixels = (coefficients[:, 0] * np.frombuffer(quant, np.uint8).astype(np.int64)).astype(np.float64) @ BASIS
    return np.clip(np.floor_divide(pixels + 2048, 4096) + 128, 0, 255).astype(np.uint8)
