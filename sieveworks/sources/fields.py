"""Readers of the metadata that media files carry: one Field for each tag, text, time or block."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import types as T

from sieveworks.sources import flat, tree
from sieveworks.sources.units import Malformed

FIELDS = T.ArrayType(
    T.StructType().add("section", "string").add("path", "string").add("name", T.BinaryType()).add("raw", T.BinaryType()).add("size", "long").add("detail", T.MapType(T.StringType(), T.StringType())).add("level", "integer").add("parent", "integer")
)


class Field(NamedTuple):
    """raw holds the value's bytes (None: there is none to show), size the bytes that it takes in the file.

    level is the depth in the file's tree: a field's parent is the last one before it that is a level higher.
    """

    section: str
    path: str
    name: bytes
    raw: bytes | None
    size: int
    detail: dict[str, str] = {}  # noqa: RUF012
    level: int = 0


def shown(raw: bytes) -> str:
    """Bytes as text: controls become ``?``, and if they aren't UTF-8, all beyond ASCII too. NULs and spaces at the end go."""
    raw = raw.rstrip(b"\0 ")
    try:
        return re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "?", raw.decode())
    except UnicodeDecodeError:
        return re.sub(r"[^\t\n\r\x20-\x7E]", "?", raw.decode("latin-1"))


def rows(found: Iterator[Field]) -> Iterator[dict]:
    """The fields with the position of each one's parent, -1 for the file itself."""
    last: list[int] = []
    for seq, field in enumerate(found):
        last[field.level :] = [seq]
        yield field._asdict() | {"parent": last[field.level - 1] if field.level else -1}


def _riff(units: Iterator, kept: tuple[str, ...] | None, data: bytes) -> Iterator[Field]:
    for u in units:
        if u.role == "info":
            yield Field("info", "", u.id.strip().encode("latin-1"), data[u.body : u.body + u.size], u.size)
        elif (kept is None and u.role in ("id3 ", "DISP")) or (kept and u.role not in (*kept, "tail")):
            kind = f"LIST-{data[u.body : u.body + 4].decode('latin-1')}" if u.role == "LIST" and u.size >= 4 else u.id.strip()
            if kind != "LIST-INFO":
                yield Field("chunks", "", kind.encode("latin-1"), None, u.size)


def wav(data: bytes) -> Iterator[Field]:
    return _riff(flat.wav(data), ("fmt ", "fact", "data"), data)


def avi(data: bytes) -> Iterator[Field]:
    return _riff(flat.avi(data), None, data)


def webp(data: bytes) -> Iterator[Field]:
    for u in flat.webp(data):
        if u.role in ("EXIF", "XMP ", "ICCP"):
            yield Field("chunks", "", u.id.encode(), data[u.body : u.body + u.size], u.size)


def jpeg(data: bytes) -> Iterator[Field]:
    for u in flat.jpeg(data):
        if u.role.startswith("APP") or u.role == "COM":
            yield Field("segments", "", u.id.encode(), data[u.body : u.stop], u.size)


def _png_text(role: str, data: bytes) -> Field | None:
    keyword, found, rest = data.partition(b"\0")
    if role == "tEXt" and found:
        return Field("text", "", keyword, rest, len(data))
    if role in ("zTXt", "iCCP") and rest:
        return Field("profiles" if role == "iCCP" else "compressedText", "", keyword, None, len(rest) - 1, {"method": str(rest[0])})
    if role == "iTXt" and len(rest) >= 2:
        language, more, rest2 = rest[2:].partition(b"\0")
        _, last, text = rest2.partition(b"\0")
        if more and last:
            return Field("translatedText", "", keyword, text, len(data), {"compressed": str(rest[0] != 0).lower(), "lang": shown(language)})
    if role == "eXIf":
        return Field("exif", "", b"", None, len(data))
    if role == "tIME" and len(data) == 7:
        year, *others = struct.unpack(">H5B", data)
        month, day, hour, minute, second = others
        return Field("time", "", b"time", f"{year}-{month:02}-{day:02} {hour:02}:{minute:02}:{second:02}".encode(), 7)
    return None


#: Chunks that a PNG may hold without a word about its maker.
_PNG_PLAIN = frozenset("IHDR PLTE IDAT IEND tRNS sRGB gAMA cHRM sBIT bKGD hIST pHYs sPLT acTL fcTL fdAT".split())


def png(data: bytes) -> Iterator[Field]:
    for u in flat.png(data):
        if u.role not in _PNG_PLAIN:
            payload = data[u.body : u.body + u.size]
            yield _png_text(u.role, payload) or Field("chunks", "", u.id.encode("latin-1"), None, u.size)


def _joined(data: bytes, at: int, stop: int) -> bytes:
    parts = []
    while at < stop and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts)


def gif(data: bytes) -> Iterator[Field]:
    for u in flat.gif(data):
        if u.role == "COMMENT":
            yield Field("comments", "", b"", _joined(data, u.body, u.stop), u.size)
        elif u.role == "TEXT":
            text = _joined(data, u.body, u.stop)
            yield Field("texts", "", b"", text[12:] if len(text) > 12 else text, u.size)
        elif u.role in ("APP", "NETSCAPE"):
            yield Field("apps", "", data[u.body + 1 : u.body + 12] if data[u.body] == 11 else b"unknown", None, u.size)


def _times(data: bytes, box: tree.Box) -> Iterator[Field]:
    """Creation and modification as seconds since 1904."""
    if box.body + 4 <= box.stop:
        version = data[box.body]
        code, n = (">QQ", 20) if version == 1 else (">II", 12)
        if box.body + n <= box.stop:
            made, changed = struct.unpack_from(code, data, box.body + 4)
            yield Field("timestamps", "", box.kind.encode(), None, box.stop - box.start, {"version": str(version), "creation": str(made), "modification": str(changed)})


def _node(data: bytes, box: tree.Box, path: str, level: int = 0) -> Iterator[Field]:
    """A box without inner boxes as one field with its text, or else all that are inside."""
    path, label = f"{path}/{box.kind}".strip("/"), box.kind.encode("latin-1")
    start = box.body + 4 * (box.kind == "meta")
    try:
        inner = list(tree.boxes(data, start, box.stop))
    except Malformed:
        inner = []
    if inner and inner[-1].stop == box.stop and all(data[b.start : b.start + 4] != bytes(4) for b in inner):
        yield Field("boxes", path, label, None, box.stop - box.start, {}, level)
        for b in inner:
            yield from _node(data, b, path, level + 1)
    else:
        start = min(box.body + 8, box.stop) if box.kind == "data" else box.body
        yield Field("boxes", path, label, data[start : box.stop], box.stop - box.start, {}, level)


#: The inspected containers aren't quite those that cleaning enters.
_INSPECTED = (tree.CONTAINERS - {"strk", "sinf"}) | {"ilst"}


def mp4(data: bytes, at: int = 0, end: int | None = None) -> Iterator[Field]:
    for box in tree.boxes(data, at, len(data) if end is None else end):
        if box.kind in tree.TIMED:
            yield from _times(data, box)
        elif box.kind in ("udta", "meta", "uuid"):
            yield from _node(data, box, "")
        elif box.kind in _INSPECTED:
            yield from mp4(data, box.body, box.stop)


# EBML ids of tags and attachments.
_TAG, _SIMPLE_TAG, _TAG_NAME, _TAG_STRING, _TAG_BINARY = 0x7373, 0x67C8, 0x45A3, 0x4487, 0x4485
_FILE, _FILE_DATA = 0x61A7, 0x465C
_FILE_TEXTS = {0x466E: "file", 0x4660: "mime", 0x467E: "description"}
_INFO = {"Title": b"title", "MuxingApp": b"muxingApp", "WritingApp": b"writingApp"}


def _some(data: bytes, at: int, end: int) -> Iterator[tree.Element]:
    """The elements that can be read."""
    try:
        yield from tree.elements(data, at, end)
    except Malformed:
        return


def _simple_tag(data: bytes, element: tree.Element, path: str) -> Iterator[Field]:
    """A tag's inner tags, then the tag itself."""
    name, value, note = b"", b"", b""
    for e in _some(data, element.body, element.stop):
        payload = data[e.body : e.stop]
        if e.code == _TAG_NAME:
            name = payload.rstrip(b"\0 ")
        elif e.code == _TAG_STRING:
            value = payload.rstrip(b"\0 ")
        elif e.code == _TAG_BINARY:
            note = b"(binary %d bytes)" % len(payload)
        elif e.code == _SIMPLE_TAG:
            yield from _simple_tag(data, e, f"{path}/{shown(name) or '?'}".strip("/"))
    if name:
        yield Field("tags", path, name, value or note, element.stop - element.start)


def _attachment(data: bytes, element: tree.Element) -> Field:
    size, detail = 0, {}
    for e in _some(data, element.body, element.stop):
        if e.code in _FILE_TEXTS:
            detail[_FILE_TEXTS[e.code]] = shown(data[e.body : e.stop])
        elif e.code == _FILE_DATA:
            size = e.stop - e.body
    return Field("attachments", "", detail.get("file", "").encode(), None, size, detail)


def mkv(data: bytes) -> Iterator[Field]:
    segment = next((e for e in _some(data, 0, len(data)) if e.name == "Segment"), None)
    for e in _some(data, segment.body, segment.stop) if segment else ():
        for c in _some(data, e.body, e.stop) if e.name in ("Info", "Tags", "Attachments") else ():
            if e.name == "Info" and c.name in _INFO:
                yield Field("info", "", _INFO[c.name], data[c.body : c.stop], c.stop - c.body)
            elif e.name == "Info" and c.name == "DateUTC" and c.stop - c.body == 8:
                yield Field("info", "", b"dateUtc", None, 8, {"ns": str(struct.unpack_from(">q", data, c.body)[0])})
            elif c.code == _TAG and e.name == "Tags":
                for t in _some(data, c.body, c.stop):
                    if t.code == _SIMPLE_TAG:
                        yield from _simple_tag(data, t, "")
            elif c.code == _FILE and e.name == "Attachments":
                yield _attachment(data, c)


# Tags of the GPS directory.
_GPS = {1: "latRef", 2: "lat", 3: "lonRef", 4: "lon", 5: "altRef", 6: "alt"}
MOST_GPS = 64


def _gps(file: tree.Tiff, path: str, entries: list[tree.Entry]) -> Iterator[Field]:
    """References and rationals as text, "n/d n/d n/d"; degrees are left to SQL."""
    detail = {}
    for e in entries if len(entries) <= MOST_GPS else ():
        name = _GPS.get(e.tag)
        if name in ("lat", "lon") and e.size >= 24 or name == "alt" and e.size >= 8:
            n = 1 if name == "alt" else 3
            numbers = struct.unpack_from(f"{file.order}{2 * n}I", file.data, e.at)
            detail[name] = " ".join(f"{a}/{b}" for a, b in zip(numbers[::2], numbers[1::2], strict=True))
        elif name == "altRef" and e.size:
            detail[name] = str(file.data[e.at])
        elif name in ("latRef", "lonRef"):
            detail[name] = shown(file.data[e.at : e.at + e.size])
    if detail.keys() & {"lat", "lon", "alt"}:
        yield Field("gps", path, b"position", None, sum(e.size for e in entries), detail)


def _directory(file: tree.Tiff, at: int, name: str, prefix: str, level: int, depth: int, state: dict) -> Iterator[Field]:
    """A directory, its tags and, as its children too, its sub-directories and the next in its chain; each one once."""
    path = f"{prefix}/{name}".strip("/")
    found = None if at in state["seen"] or depth > tree.DEEPEST else file.directory(at)
    entries, after = found or ([], 0)
    yield Field("ifds", path, b"entries", None, len(entries), {}, level)
    if at in state["seen"] or depth > tree.DEEPEST:
        return
    state["seen"].add(at)
    inner: list[tuple[int, str]] = []
    for e in entries:
        title = tree.TAGS.get(e.tag, f"Tag{e.tag}").encode()
        if e.tag == tree.GPS_IFD:
            for place in file.offsets(e)[:1]:
                position = file.directory(file.base + place)
                yield from (f._replace(level=level + 1) for f in _gps(file, f"{prefix}/GPS".strip("/"), position[0] if position else []))
        elif e.tag in (tree.EXIF_IFD, tree.SUB_IFDS):
            places = file.offsets(e)[: None if e.tag == tree.SUB_IFDS else 1]
            inner += [(file.base + place, "ExifIFD" if e.tag == tree.EXIF_IFD else "SubIFD") for place in places]
        elif e.tag in (37500, 700):
            yield Field("blobs", path, title, None, e.size, {}, level + 1)
        elif e.type == 2:
            yield Field("tags", path, title, file.data[e.at : e.at + e.size], e.size, {}, level + 1)
    for place, kind in inner:
        yield from _directory(file, place, kind, prefix, level + 1, depth + 1, state)
    if after and after + 2 <= file.limit:
        state["chained"] += 1
        yield from _directory(file, after, f"IFD{state['chained']}", prefix, level + 1, depth + 1, state)


def tiff(data: bytes, base: int = 0, limit: int | None = None, prefix: str = "", level: int = 0) -> Iterator[Field]:
    """The byte order, then the first directory: beside it in a file of its own, below it in another's box or item."""
    file = tree.Tiff(data, base, limit)
    yield Field("tiff", prefix, b"byteOrder", b"II" if file.order == "<" else b"MM", 2, {}, level)
    yield from _directory(file, file.first, "IFD0", prefix, level + bool(prefix), 0, {"seen": set(), "chained": 0})


def cr3(data: bytes, at: int = 0, end: int | None = None) -> Iterator[Field]:
    for box in tree.boxes(data, at, len(data) if end is None else end):
        if box.kind in tree.TIMED:
            yield from _times(data, box)
        elif box.kind in ("uuid", "udta"):
            kind = tree.uuid_kind(data, box.body, box.stop) if box.kind == "uuid" else ""
            yield Field("boxes", "", box.kind.encode(), None, box.stop - box.start, {"kind": kind or "unknown"} if box.kind == "uuid" else {})
            if kind == "tiff":
                try:
                    yield from list(tiff(data, box.body, box.stop, "uuid", 1))
                except Malformed:
                    pass
        elif box.kind in tree.CONTAINERS:
            yield from cr3(data, box.body, box.stop)


def heic(data: bytes, at: int = 0, end: int | None = None) -> Iterator[Field]:
    for box in tree.boxes(data, at, len(data) if end is None else end):
        if box.kind in tree.TIMED:
            yield from _times(data, box)
        elif box.kind == "meta":
            shown = False
            for item, places in tree.heif_meta(data, box)[1]:
                yield Field("items", "", item.name, item.content, sum(n for _, n in places), {"id": str(item.number), "type": item.kind})
                if item.kind == "Exif" and places and not shown and (start := tree.heif_exif(data, *places[0])):
                    try:
                        yield from list(tiff(data, start, sum(places[0]), "Exif"))
                        shown = True
                    except Malformed:
                        pass
        elif box.kind in tree.CONTAINERS:
            yield from heic(data, box.body, box.stop)


FIELD_READERS: dict[str, Callable[[bytes], Iterator[Field]]] = {"wav": wav, "avi": avi, "webp": webp, "jpeg": jpeg, "png": png, "gif": gif, "mp4": mp4, "mkv": mkv, "raw": tiff, "cr3": cr3, "heic": heic}
