"""Whether bytes are a whole image: the container is walked from its first block to its last; pixels are not decoded."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNKNOWN, TRUNCATED, DAMAGED = "UnidentifiedImage", "Truncated", "Damaged"


class _Fault(Exception):
    """What is wrong with an image."""


def _need(data: bytes, at: int, n: int) -> None:
    if at + n > len(data):
        raise _Fault(TRUNCATED)


def _hold(sound: bool) -> None:
    if not sound:
        raise _Fault(DAMAGED)


def _png(data: bytes) -> None:
    """Chunks with their checksums: IHDR first, IDAT, IEND last."""
    at, kinds = 8, []
    while not kinds or kinds[-1] != b"IEND":
        _need(data, at, 12)
        size, kind = struct.unpack_from(">I4s", data, at)
        _hold(kind.isalpha() and size < 1 << 31)
        _need(data, at, 12 + size)
        _hold(zlib.crc32(memoryview(data)[at + 4 : at + 8 + size]) == struct.unpack_from(">I", data, at + 8 + size)[0])
        if not kinds:
            _hold(kind == b"IHDR" and size == 13 and all(struct.unpack_from(">II", data, at + 8)))
        kinds.append(kind)
        at += 12 + size
    _hold(b"IDAT" in kinds)


def _jpeg(data: bytes) -> None:
    """Segments by their lengths, a frame header with a size, and scans up to the end marker."""
    at, framed, scanned = 2, False, False
    while True:
        _need(data, at, 2)
        _hold(data[at] == 0xFF)
        while data[at + 1] == 0xFF:  # fill bytes
            at += 1
            _need(data, at, 2)
        kind = data[at + 1]
        if kind == 0xD9:
            _hold(framed and scanned)
            return
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 2
            continue
        _hold(kind >= 0xC0)
        _need(data, at, 4)
        size = struct.unpack_from(">H", data, at + 2)[0]
        _hold(size >= 2)
        _need(data, at + 2, size)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            _hold(size >= 8 and struct.unpack_from(">H", data, at + 7)[0] > 0)
            framed = True
        at += 2 + size
        if kind == 0xDA:
            _hold(framed)
            scanned = True
            while True:  # coded data: a marker is an FF that neither 00 nor a restart number follows
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise _Fault(TRUNCATED)
                if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
                    break
                at += 2


def _gif(data: bytes) -> None:
    """Blocks up to the trailer, one of them an image."""

    def after_blocks(at: int) -> int:
        while True:
            _need(data, at, 1)
            size = data[at]
            at += 1 + size
            if not size:
                return at

    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    _need(data, 0, 13)
    at, images = 13 + table(data[10]), 0
    while True:
        _need(data, at, 1)
        kind = data[at]
        if kind == 0x3B:
            _hold(images > 0)
            return
        _hold(kind in (0x21, 0x2C))
        if kind == 0x21:
            at = after_blocks(at + 2)
            continue
        _need(data, at, 11)
        at += 10 + table(data[at + 9])
        _need(data, at, 1)
        _hold(1 <= data[at] <= 11)
        at, images = after_blocks(at + 1), images + 1


def _webp(data: bytes) -> None:
    """Chunks that fill the size of the whole, one of them (or of a frame's) an image with its signature."""
    _need(data, 0, 20)
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    _need(data, 0, end)
    at, images = 12, 0
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        _hold(at + 8 + size <= end)
        body = at + 8
        if kind == b"VP8 ":
            _hold(size >= 10 and data[body + 3 : body + 6] == b"\x9d\x01\x2a")
        if kind == b"VP8L":
            _hold(size >= 5 and data[body] == 0x2F)
        images += kind in (b"VP8 ", b"VP8L", b"ANMF")
        at = body + size + size % 2
    _hold(images > 0)


def _bmp(data: bytes) -> None:
    """Pixels from the place that the header names, as many as its sizes and depth need unless they are compressed."""
    _need(data, 0, 26)
    start, header = struct.unpack_from("<II", data, 10)
    if header < 40:
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
        packed = False
    else:
        _need(data, 0, 34)
        width, height, _, bits, form = struct.unpack_from("<iiHHI", data, 18)
        packed = form not in (0, 3, 6)
    _hold(width > 0 and height != 0 and bits in (1, 2, 4, 8, 16, 24, 32) and start >= 14 + min(header, 12))
    _need(data, start, 1 if packed else (width * bits + 31) // 32 * 4 * abs(height))


def fault(data: bytes | None) -> str | None:
    """What is wrong with an image's bytes: of no known kind, cut short, or damaged; None for a whole PNG, JPEG, GIF, WebP or BMP. Bytes after the end don't matter."""
    kinds = {b"\x89PNG\r\n\x1a\n": _png, b"\xff\xd8\xff": _jpeg, b"GIF87a": _gif, b"GIF89a": _gif, b"BM": _bmp}
    walk = next((f for head, f in kinds.items() if data and data.startswith(head)), None)
    if walk is None and data and data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        walk = _webp
    if walk is None:
        return UNKNOWN
    try:
        walk(data)
    except _Fault as found:
        return str(found)
    return None


@F.pandas_udf(StringType())
def _faults(content: pd.Series) -> pd.Series:
    return content.map(fault)


def image_fault(content: Column) -> Column:
    """fault() of a binary column."""
    return _faults(content)
