"""Readers of formats that are a list of parts: RIFF (WAV, WebP, AVI), JPEG, PNG and GIF."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from sieveworks.sources.units import Malformed, Unit, fourcc


def _chunks(data: bytes, at: int, end: int, pad_needed: bool) -> Iterator[tuple[str, int, int, int]]:
    """(id, body, size, stop) of each RIFF chunk in at..end; an odd chunk's stop is past its pad byte where there is one."""
    while at + 8 <= end:
        name, (size,) = fourcc(data, at), struct.unpack("<I", data[at + 4 : at + 8])
        body, stop = at + 8, at + 8 + size
        if stop > end:
            raise Malformed(f"truncated chunk '{name}' (declared {size} bytes)")
        if size % 2:
            if stop < end:
                stop += 1
            elif pad_needed:
                raise Malformed(f"missing padding after chunk '{name}'")
        yield name, body, size, stop
        at = stop


def _info(data: bytes, body: int, size: int) -> Iterator[Unit]:
    """The entries of an INFO list, for inspection only: what can't be read ends them."""
    try:
        for name, at, n, stop in _chunks(data, body + 4, body + size, False):
            yield Unit(name, "info", n, at - 8, at, stop)
    except Malformed:
        return


def wav(data: bytes) -> Iterator[Unit]:
    stop = 12
    for name, body, size, stop in _chunks(data, 12, len(data), False):
        kind = fourcc(data, body) if name == "LIST" and size >= 4 else ""
        yield Unit(name, name, size, body - 8, body, stop)
        if kind == "INFO":
            yield from _info(data, body, size)
    if len(data) - stop > 1:
        raise Malformed(f"trailing garbage after last chunk ({len(data) - stop} bytes)")
    if stop < len(data):
        yield Unit("", "tail", 0, stop, stop, len(data))


def webp(data: bytes) -> Iterator[Unit]:
    (declared,) = struct.unpack_from("<I", data, 4)
    if len(data) - 8 - declared not in (0, 1):
        raise Malformed("truncated file (bad RIFF size)" if declared + 8 > len(data) else "trailing garbage after last chunk")
    stop = 12
    for name, body, size, stop in _chunks(data, 12, len(data), True):
        yield Unit(name.strip(), name, size, body - 8, body, stop)
    if len(data) - stop > 1:
        raise Malformed(f"trailing garbage after last chunk ({len(data) - stop} bytes)")
    if stop < len(data):
        yield Unit("", "tail", 0, stop, stop, len(data))


def avi(data: bytes, at: int = 12, end: int | None = None) -> Iterator[Unit]:
    """Lists are entered, but for INFO and movi."""
    end = len(data) if end is None else end
    for name, body, size, stop in _chunks(data, at, end, end != len(data)):
        if name != "LIST":
            yield Unit(name.strip(), name, size, body - 8, body, stop)
            continue
        if size < 4:
            raise Malformed("invalid LIST chunk size")
        kind = fourcc(data, body)
        yield Unit(f"LIST-{kind}", f"LIST-{kind}", size, body - 8, body, stop)
        if kind == "INFO":
            yield from _info(data, body, size)
        elif kind != "movi":
            yield from avi(data, body + 4, body + size)


# Names of JPEG markers.
_MARKERS = {0xC0: "SOF0", 0xC1: "SOF1", 0xC2: "SOF2", 0xC4: "DHT", 0xDA: "SOS", 0xDB: "DQT", 0xDD: "DRI", 0xFE: "COM", 0x01: "TEM", 0xD8: "SOI", 0xD9: "EOI"}
_STANDALONE = {0x01, *range(0xD0, 0xDA)}


def marker_name(code: int) -> str:
    if 0xE0 <= code <= 0xEF:
        return f"APP{code - 0xE0}"
    if 0xD0 <= code <= 0xD7:
        return f"RST{code - 0xD0}"
    return _MARKERS.get(code, f"M{code:02X}")


def jpeg_segments(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(code, marker, body, stop) from the marker after SOI up to EOI or the first SOS; fill bytes come before marker."""
    while at < end:
        if data[at] != 0xFF:
            raise Malformed(f"invalid JPEG marker at offset {at}")
        code_at = at
        while code_at < end and data[code_at] == 0xFF:
            code_at += 1
        if code_at >= end or data[code_at] == 0:
            raise Malformed(f"invalid or truncated JPEG marker at offset {at}")
        code = data[code_at]
        if code in _STANDALONE:
            body = stop = code_at + 1
        elif code_at + 2 >= end:
            raise Malformed(f"truncated JPEG segment '{marker_name(code)}'")
        else:
            body, stop = code_at + 3, code_at + 1 + struct.unpack_from(">H", data, code_at + 1)[0]
            if not body <= stop <= end:
                raise Malformed(f"bad length of JPEG segment '{marker_name(code)}'")
        yield code, code_at - 1, body, stop
        at = stop
        if code in (0xD9, 0xDA):
            return


def jpeg(data: bytes) -> Iterator[Unit]:
    """Fill bytes are parts of their own; all that follows the first SOS header belongs to no part."""
    yield Unit("SOI", "SOI", 0, 0, 2, 2)
    before, code = 2, 0
    for code, marker, body, stop in jpeg_segments(data, 2, len(data)):
        if marker > before:
            yield Unit("", "fill", 0, before, before, marker)
        yield Unit(name := marker_name(code), name, stop - body, marker, body, stop)
        before = stop
    if code == 0xDA and (before >= len(data) or data[-2:] != b"\xff\xd9") or code not in (0xD9, 0xDA):
        raise Malformed("JPEG missing scan or EOI marker")
    if code == 0xD9 and before != len(data):
        raise Malformed(f"trailing garbage after JPEG EOI ({len(data) - before} bytes)")


def jpeg_metadata(data: bytes, start: int, stop: int) -> tuple[tuple[int, int], ...]:
    """Byte ranges of the APPn and COM payloads of a JPEG inside a file; none unless it is well formed."""
    if start < 0 or stop - start < 4 or data[start : start + 2] != b"\xff\xd8":
        return ()
    found, code = [], 0
    try:
        for code, _, body, end in jpeg_segments(data, start + 2, stop):
            if (0xE0 <= code <= 0xEF or code == 0xFE) and end > body:
                found.append((body, end - body))
    except Malformed:
        return ()
    return tuple(found) if code == 0xD9 or data[stop - 2 : stop] == b"\xff\xd9" else ()


def png(data: bytes) -> Iterator[Unit]:
    at = 8
    while at + 8 <= len(data):
        (size,), name = struct.unpack_from(">I", data, at), fourcc(data, at + 4)
        body, stop = at + 8, at + 12 + size
        if stop > len(data):
            raise Malformed(f"truncated PNG chunk at offset {at} (declared {size} bytes)")
        if zlib.crc32(memoryview(data)[at + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            raise Malformed(f"corrupt PNG chunk '{name}' (CRC mismatch)")
        yield Unit(name, name, size, at, body, stop)
        at = stop
    if at != len(data):
        raise Malformed(f"truncated PNG file (ends mid-chunk at offset {at})")


def _past_sub_blocks(data: bytes, at: int) -> int:
    """The offset after a chain of GIF sub-blocks."""
    while at < len(data):
        n = data[at]
        at += 1 + n
        if not n:
            return at
    raise Malformed("truncated GIF sub-block")


def _color_table(flags: int) -> int:
    return 3 << (flags & 7) + 1 if flags & 0x80 else 0


# Labels of GIF extensions.
_EXTENSIONS = {0xF9: "GCE", 0xFE: "COMMENT", 0x01: "TEXT", 0xFF: "APP"}


def gif(data: bytes) -> Iterator[Unit]:
    at = 13 + _color_table(data[10])
    if at > len(data):
        raise Malformed("truncated GIF global color table")
    yield Unit("HDR", "HDR", 13, 0, 13, at)
    while at < len(data):
        if data[at] == 0x3B:
            yield Unit("TRL", "TRL", 1, at, at + 1, at + 1)
            if at + 1 != len(data):
                raise Malformed(f"trailing garbage after GIF trailer ({len(data) - at - 1} bytes)")
            return
        if data[at] == 0x2C:
            if at + 10 > len(data):
                raise Malformed("truncated GIF image descriptor")
            name = role = "IMG"
            stop = _past_sub_blocks(data, at + 11 + _color_table(data[at + 9]))
        elif data[at] == 0x21 and at + 1 < len(data) and (role := _EXTENSIONS.get(data[at + 1], "")):
            stop, name = _past_sub_blocks(data, at + 2), role
            if role == "APP":
                known = data[at + 3 : at + 14].decode("latin-1") if data[at + 2] == 11 and at + 14 <= len(data) else ""
                name, role = ("NETSCAPE", "NETSCAPE") if known == "NETSCAPE2.0" else (f"APP-{known[:8] or 'APP'}", "APP")
        else:
            raise Malformed(f"unknown GIF block at offset {at}")
        yield Unit(name, role, stop - at, at, at + 2, stop)
        at = stop
    raise Malformed("truncated GIF file (missing trailer)")
