"""Readers of formats whose parts are nested: ISO base media (MP4, CR3, HEIC), EBML (MKV) and TIFF (camera RAW)."""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from sieveworks.sources.flat import jpeg_metadata
from sieveworks.sources.units import Malformed, Unit, fourcc

# Boxes that hold boxes, and boxes that hold times.
CONTAINERS = frozenset("moov trak edts mdia minf dinf stbl mvex moof traf mfra strk sinf".split())
TIMED = frozenset("mvhd tkhd mdhd".split())


class Box(NamedTuple):
    kind: str
    start: int
    body: int
    stop: int

    def unit(self, name: str = "", role: str = "", zones: tuple[tuple[int, int], ...] | None = None) -> Unit:
        zones = ((self.body, self.stop - self.body),) if zones is None else zones
        return Unit(name or self.kind, role or name or self.kind, self.stop - self.start, self.start, self.body, self.stop, zones)


def boxes(data: bytes, at: int, end: int) -> Iterator[Box]:
    """The boxes in at..end; fewer than eight bytes at the end are ignored."""
    while at + 8 <= end:
        (size,), kind, body = struct.unpack(">I", data[at : at + 4]), fourcc(data, at + 4), at + 8
        if size == 1:
            body = at + 16
            if body > end:
                raise Malformed(f"truncated box '{kind}' (missing largesize)")
            (size,) = struct.unpack(">Q", data[at + 8 : at + 16])
        elif size == 0:
            size = end - at
        if at + size < body:
            raise Malformed(f"invalid box size for '{kind}'")
        if at + size > end:
            raise Malformed(f"truncated box '{kind}' (declared {size} bytes, parent ends early)")
        yield Box(kind, at, body, at + size)
        at += size


def _timed(data: bytes, box: Box) -> Unit:
    """Creation and modification times stand after version and flags, in 8 or 16 bytes."""
    n = 16 if box.body < box.stop and data[box.body] == 1 else 8
    return box.unit(zones=((box.body + 4, n),) if box.body + 4 + n <= box.stop else ())


def mp4(data: bytes, at: int = 0, end: int | None = None) -> Iterator[Unit]:
    for box in boxes(data, at, len(data) if end is None else end):
        yield _timed(data, box) if box.kind in TIMED else box.unit()
        if box.kind in CONTAINERS:
            yield from mp4(data, box.body, box.stop)


# Names of EBML elements.
ELEMENTS = {
    0x1A45DFA3: "EBML", 0x18538067: "Segment", 0x114D9B74: "SeekHead", 0x1549A966: "Info", 0x1654AE6B: "Tracks",
    0x1043A770: "Chapters", 0x1254C367: "Tags", 0x1941A469: "Attachments", 0x1C53BB6B: "Cues", 0x1F43B675: "Cluster",
    0xEC: "Void", 0xBF: "CRC-32", 0x7BA9: "Title", 0x4461: "DateUTC", 0x4D80: "MuxingApp", 0x5741: "WritingApp",
    0x2AD7B1: "TimestampScale", 0x4489: "Duration", 0x73A4: "SegmentUID",
}
#: What of an Info element says who made the file, and when.
PERSONAL_INFO = frozenset("Title DateUTC MuxingApp WritingApp".split())


class Element(NamedTuple):
    name: str
    code: int
    start: int
    body: int
    stop: int

    def unit(self, prefix: str = "", role: str = "") -> Unit:
        name = prefix + self.name
        return Unit(name, role or name, self.stop - self.start, self.start, self.body, self.stop)


def _vint(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(value with its length marker, bytes) of the variable-length integer at at."""
    if at >= end or not data[at] or at + (n := 9 - data[at].bit_length()) > end:
        raise Malformed(f"truncated or invalid EBML number at offset {at}")
    return int.from_bytes(data[at : at + n], "big"), n


def elements(data: bytes, at: int, end: int) -> Iterator[Element]:
    """The EBML elements in at..end; unknown sizes run to the end."""
    while at + 2 <= end:
        code, n = _vint(data, at, end)
        coded, m = _vint(data, at + n, end)
        body, size, unknown = at + n + m, coded - (1 << 7 * m), (1 << 7 * m) - 1
        name = ELEMENTS.get(code, f"E{code}")
        stop = end if size == unknown else body + size
        if stop > end:
            raise Malformed(f"truncated EBML element '{name}' (declared {size} bytes, parent ends early)")
        yield Element(name, code, at, body, stop)
        at = stop
    if at != end:
        raise Malformed("truncated EBML element")


def mkv(data: bytes) -> Iterator[Unit]:
    """Top-level elements up to the first Segment, its children, and the children of Info."""
    end, top = 0, []
    try:
        for top_element in elements(data, 0, len(data)):
            top.append(top_element)
            end = top_element.stop
            if top_element.name == "Segment":
                break
    except Malformed:
        if len(data) - end >= 2:  # a lone last byte only hides the missing Segment
            raise
    for element in top:
        if element.name not in ("EBML", "Segment", "Void", "CRC-32"):
            raise Malformed(f"unexpected top-level element '{element.name}'")
        yield element.unit()
    if not top or top[-1].name != "Segment":
        return
    if end != len(data):
        raise Malformed(f"trailing garbage after Segment ({len(data) - end} bytes)")
    for element in elements(data, top[-1].body, end):
        yield element.unit(role="Info" if element.name == "Info" else "")
        if element.name == "Info":
            children = list(elements(data, element.body, element.stop))
            checksums = [c for c in children if c.name == "CRC-32"][-1:]
            yield from (c.unit("Info/") for c in children if c.name != "CRC-32")
            stale = any(c.name in PERSONAL_INFO for c in children)
            yield from (c.unit("Info/", "Info/CRC-32 stale" if stale else "Info/CRC-32") for c in checksums)


# Bytes of a value of each TIFF type, and names of tags.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 8, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TAGS = {
    270: "ImageDescription", 271: "Make", 272: "Model", 305: "Software", 306: "DateTime", 315: "Artist", 700: "XMP",
    33432: "Copyright", 33723: "IPTC", 34377: "Photoshop", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized",
    37500: "MakerNote", 37510: "UserComment", 37520: "SubSecTime", 37521: "SubSecTimeOriginal",
    37522: "SubSecTimeDigitized", 40091: "XPTitle", 40092: "XPComment", 40093: "XPAuthor", 40094: "XPKeywords",
    40095: "XPSubject", 42016: "ImageUniqueID",
}
EXIF_IFD, GPS_IFD, SUB_IFDS, INTEROP_IFD, JPEG_AT, JPEG_BYTES = 34665, 34853, 330, 40965, 513, 514
#: Tags whose values are cleared; those of the camera stay, as decoders need them.
PRIVATE_TAGS = frozenset(TAGS.keys() - {271, 272, 37500})
MOST_ENTRIES, MOST_OFFSETS, DEEPEST = 512, 4096, 16


class Entry(NamedTuple):
    """A TIFF directory entry whose value lies inside the file: at..at + size."""

    tag: int
    type: int
    count: int
    at: int
    size: int


class Overlay:
    """The bytes of a file as they stand after its edits so far: ranges that were cleared read as zeros.

    The file itself isn't copied; cleared ranges are kept apart and in order, so a read costs a search.
    """

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.starts: list[int] = []
        self.stops: list[int] = []

    def clear(self, at: int, n: int) -> None:
        stop = at + n
        if not n:
            return
        first, last = bisect_left(self.stops, at), bisect_right(self.starts, stop)
        if first < last:
            at, stop = min(at, self.starts[first]), max(stop, self.stops[last - 1])
        self.starts[first:last], self.stops[first:last] = [at], [stop]

    def read(self, at: int, n: int) -> bytes:
        k, stop = bisect_right(self.stops, at), at + n
        if k == len(self.starts) or self.starts[k] >= stop:
            return self.data[at:stop]
        out = bytearray(self.data[at:stop])
        for start, end in zip(self.starts[k:], self.stops[k:], strict=True):
            if start >= stop:
                break
            start, end = max(start, at) - at, min(end, stop) - at
            out[start:end] = bytes(end - start)
        return bytes(out)


class Tiff:
    """A TIFF structure in base..limit of a file, read through the edits that were made before (now)."""

    def __init__(self, data: bytes, base: int = 0, limit: int | None = None, now: Overlay | None = None) -> None:
        self.data, self.base, self.limit = data, base, len(data) if limit is None else limit
        self.now = Overlay(data) if now is None else now
        order = self.now.read(base, 2)
        if base + 8 > self.limit or order not in (b"II", b"MM"):
            raise Malformed("not a TIFF-based RAW file (bad byte order)")
        self.order = "<" if order == b"II" else ">"
        magic, first = self._numbers("HI", base + 2)
        if magic != 42:
            raise Malformed("not a TIFF-based RAW file (bad magic, BigTIFF unsupported)")
        if base + first + 2 > self.limit:
            raise Malformed("truncated TIFF file (bad first IFD offset)")
        self.first = base + first

    def _numbers(self, form: str, at: int) -> tuple[int, ...]:
        return struct.unpack(self.order + form, self.now.read(at, struct.calcsize(self.order + form)))

    def extent(self, at: int) -> int | None:
        """Where the entries of the directory at at end; None: there is none."""
        if at + 2 > self.limit:
            return None
        (count,) = self._numbers("H", at)
        end = at + 2 + 12 * count
        return None if count > MOST_ENTRIES or end + 4 > self.limit else end

    def entry(self, at: int) -> Entry | None:
        """The entry at at, if it has a value."""
        tag, kind, n, offset = self._numbers("HHII", at)
        size = n * TYPE_BYTES.get(kind, 0)
        where = at + 8 if size <= 4 else self.base + offset
        return Entry(tag, kind, n, where, size) if kind in TYPE_BYTES and where + size <= self.limit else None

    def after(self, end: int) -> int:
        """The directory that follows the one whose entries end at end; 0: none."""
        (after,) = self._numbers("I", end)
        return self.base + after if after else 0

    def directory(self, at: int) -> tuple[list[Entry], int] | None:
        """(entries with a value, the next directory's place or 0) of the directory at at; None: there is none."""
        end = self.extent(at)
        return None if end is None else ([e for k in range(at + 2, end, 12) if (e := self.entry(k))], self.after(end))

    def offsets(self, entry: Entry) -> list[int]:
        """An entry's values as offsets, for unsigned types."""
        code = {3: "H", 4: "I", 13: "I"}.get(entry.type)
        if code is None or not 0 < entry.count <= MOST_OFFSETS:
            return []
        return list(self._numbers(f"{entry.count}{code}", entry.at))

    def units(self) -> Iterator[Unit]:
        """Parts in the order in which they are cleared: what is cleared first is read as zeros by all that follow."""
        self.seen, self.chained, self.thumbs, self.cleared = set(), 0, [], []
        yield from self._units(self.first, "IFD0", 0)
        zones = []
        for start, stop in self.thumbs:
            found = jpeg_metadata(self.now.read(start, stop - start), 0, stop - start)
            zones += [(start + at, n) for at, n in found]
            for at, n in found:
                self.now.clear(start + at, n)
        if zones:
            yield Unit("THMB", "thumb", sum(n for _, n in zones), zones[0][0], zones[0][0], zones[0][0], tuple(zones))

    def _units(self, at: int, name: str, depth: int) -> Iterator[Unit]:
        if at in self.seen or depth > DEEPEST:
            return
        self.seen.add(at)
        end = self.extent(at)
        if end is None:
            return
        yield Unit(name, "ifd", end + 4 - at, at, at, at)
        starts: list[int] = []
        sizes: list[int] = []
        for k in range(at + 2, end, 12):
            entry = self.entry(k)
            if entry is None:
                continue
            if name == "GPS":
                if entry.size:
                    self.now.clear(entry.at, entry.size)
                    self.cleared.append((entry.at, entry.size))
            elif entry.tag == GPS_IFD:
                for offset in self.offsets(entry)[:1]:
                    self.cleared = []
                    yield from self._units(self.base + offset, "GPS", depth + 1)
                    yield Unit("GPS", "gps", sum(n for _, n in self.cleared), entry.at, entry.at, entry.at, tuple(self.cleared))
            elif entry.tag == EXIF_IFD:
                for offset in self.offsets(entry)[:1]:
                    yield from self._units(self.base + offset, "ExifIFD", depth + 1)
            elif entry.tag == SUB_IFDS:
                for offset in self.offsets(entry):
                    yield from self._units(self.base + offset, "SubIFD", depth + 1)
            elif entry.tag in (JPEG_AT, JPEG_BYTES):
                (starts if entry.tag == JPEG_AT else sizes).extend(self.offsets(entry))
            elif entry.tag != INTEROP_IFD:
                if entry.tag in PRIVATE_TAGS:
                    self.now.clear(entry.at, entry.size)
                yield Unit(TAGS.get(entry.tag, f"Tag{entry.tag}"), f"tag{entry.tag}", entry.size, entry.at, entry.at, entry.at + entry.size, ((entry.at, entry.size),))
        if name == "GPS":
            return
        self.thumbs += [(self.base + s, self.base + s + n) for s, n in zip(starts, sizes, strict=False) if self.base + s + n <= self.limit]
        after = self.after(end)
        if after and after + 2 <= self.limit:
            self.chained += 1
            yield from self._units(after, f"IFD{self.chained}", depth + 1)


def tiff(data: bytes, base: int = 0, limit: int | None = None, now: Overlay | None = None) -> Iterator[Unit]:
    """Directories, the values of their tags, GPS values as one part, and the metadata of embedded JPEGs as one part."""
    yield from Tiff(data, base, limit, now).units()


# What an XMP packet starts with or names.
XMP_NAMESPACE, XMP_STARTS, SNIFFED = b"http://ns.adobe.com/xap/1.0/", (b"<?xpacket", b"<x:"), 4096


def uuid_kind(data: bytes, start: int, stop: int) -> str:
    """What the payload of a uuid box looks like."""
    head = data[start : min(stop, start + SNIFFED)]
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    if head[:2] == b"\xff\xd8":
        return "jpeg"
    return "xmp" if XMP_NAMESPACE in head or head.strip().startswith(XMP_STARTS) else ""


def _uuid(data: bytes, box: Box, now: Overlay) -> Iterator[Unit]:
    kind = uuid_kind(data, box.body, box.stop)
    zones = jpeg_metadata(data, box.body, box.stop) if kind == "jpeg" else ()
    for at, n in ((box.body, box.stop - box.body),) if kind == "xmp" else zones:
        now.clear(at, n)
    if kind == "xmp":
        yield box.unit("uuid-XMP")
    elif zones:
        yield box.unit("uuid-JPEG", zones=zones)._replace(size=sum(n for _, n in zones))
    elif kind != "tiff":
        yield box.unit(role="uuid-other")
    else:
        try:
            yield from tiff(data, box.body, box.stop, now)
        except Malformed:
            yield box.unit(role="uuid-other")


def cr3(data: bytes, at: int = 0, end: int | None = None) -> Iterator[Unit]:
    for box in boxes(data, at, len(data) if end is None else end):
        if box.kind == "uuid":
            yield from _uuid(data, box, Overlay(data))
        elif box.kind == "prvw" and (zones := jpeg_metadata(data, box.body, box.stop)):
            yield box.unit("PRVW", zones=zones)._replace(size=sum(n for _, n in zones))
        else:
            yield _timed(data, box) if box.kind in TIMED else box.unit()
            if box.kind in CONTAINERS:
                yield from cr3(data, box.body, box.stop)


MOST_ITEMS, MOST_EXTENTS = 10_000, 100_000


class Item(NamedTuple):
    number: int
    kind: str
    name: bytes
    content: bytes


def heif_items(data: bytes, start: int, stop: int) -> Iterator[Item]:
    """The entries of an iinf box, from infe boxes of versions 2 and 3."""
    wide = start < stop and data[start] != 0
    at = start + (8 if wide else 6)
    if at > stop:
        return
    most = min(int.from_bytes(data[start + 4 : at], "big"), MOST_ITEMS)
    try:
        for k, box in enumerate(boxes(data, at, stop)):
            if k >= most:
                return
            version = data[box.body] if box.body < box.stop else 0
            n = {2: 2, 3: 4}.get(version)
            at = box.body + 6 + (n or 0)
            if box.kind != "infe" or n is None or at + 4 > box.stop:
                continue
            name, _, rest = data[at + 4 : box.stop].partition(b"\0")
            kind = fourcc(data, at)
            yield Item(int.from_bytes(data[box.body + 4 : box.body + 4 + n], "big"), kind, name, rest.partition(b"\0")[0] if kind == "mime" else b"")
    except Malformed:
        return


def heif_places(data: bytes, start: int, stop: int, idat: int | None) -> dict[int, list[tuple[int, int]]]:
    """Item number to the (offset, bytes) of its extents, from an iloc box; the first entry of a number counts.

    Places are resolved for construction by file offset and, with an idat box, by its offset. An item with an extent
    that can't be, or lies outside the file, has none.
    """
    if start + 8 > stop or (version := data[start]) > 2:
        return {}
    widths = [data[start + 4] >> 4, data[start + 4] & 15, data[start + 5] >> 4, data[start + 5] & 15]
    if max(widths) > 8 or version == 0 and widths[3]:
        return {}
    offset_n, length_n, base_n, index_n = widths
    at, wide = start + 6, 4 if version == 2 else 2

    def number(n: int) -> int:
        nonlocal at
        if at + n > stop:
            raise Malformed("truncated iloc box")
        at += n
        return int.from_bytes(data[at - n : at], "big")

    found: dict[int, list[tuple[int, int]]] = {}
    try:
        count = number(wide)
        for _ in range(count if count <= MOST_EXTENTS else 0):
            item = number(wide)
            method = number(2) if version else 0
            number(2)
            base, extents = number(base_n), number(2)
            origin = {0: 0, 1: idat}.get(method)
            places, good = [], False
            try:
                for _ in range(extents):
                    number(index_n)
                    offset, size = number(offset_n), number(length_n)
                    if origin is None or origin + base + offset + size > len(data):
                        break
                    places.append((origin + base + offset, size))
                else:
                    good = True
            finally:
                found.setdefault(item, places if good else [])
    except Malformed:
        pass
    return found


def is_xmp(item: Item) -> bool:
    return item.kind == "mime" and any(x in item.content for x in (b"rdf", b"xap", b"xml"))


def heif_exif(data: bytes, at: int, size: int, now: Overlay | None = None) -> int | None:
    """Where the TIFF of an Exif item starts: a 32-bit distance stands before it."""
    base = at + 4 + int.from_bytes((now or Overlay(data)).read(at, 4), "big")
    return base if size >= 8 and base + 8 <= at + size else None


def _item(data: bytes, item: Item, places: list[tuple[int, int]], now: Overlay) -> Iterator[Unit]:
    """An item's parts; items may share extents, so each is read as those before it left it."""
    total = sum(n for _, n in places)
    at = places[0][0] if places else 0
    unit = Unit(f"ITEM-{item.kind}", "item", total, at, at, at, tuple(places))
    if not places and (item.kind == "Exif" or is_xmp(item)):
        yield unit
    elif is_xmp(item):
        for at, n in places:
            now.clear(at, n)
        yield unit._replace(id="XMP", role="item-xmp")
    elif item.kind != "Exif":
        yield unit
    else:
        (at, size), rest = places[0], places[1:]
        base = heif_exif(data, at, size, now)
        try:
            if base is None:
                raise Malformed("no TIFF in the Exif item")
            yield from tiff(data, base, at + size, now)
        except Malformed:
            now.clear(at, size)
            yield unit._replace(id="Exif", role="item-exif", size=size, zones=((at, size),))
        for start, n in rest:
            now.clear(start, n)
        if more := sum(n for _, n in rest):
            yield unit._replace(id="Exif", role="item-exif", size=more, zones=tuple(rest))


def heif_meta(data: bytes, box: Box) -> tuple[list[Box], list[tuple[Item, list[tuple[int, int]]]]]:
    """The boxes inside a meta box, and its items with their places."""
    try:
        inner = list(boxes(data, box.body + 4, box.stop)) if box.body + 4 <= box.stop else []
    except Malformed:
        return [], []
    last = {b.kind: b for b in inner}
    if "iinf" not in last or "iloc" not in last:
        return inner, []
    idat = last["idat"].body if "idat" in last else None
    places = heif_places(data, last["iloc"].body, last["iloc"].stop, idat)
    return inner, [(item, places.get(item.number, [])) for item in heif_items(data, last["iinf"].body, last["iinf"].stop)]


def heic(data: bytes, at: int = 0, end: int | None = None, now: Overlay | None = None) -> Iterator[Unit]:
    now = Overlay(data) if now is None else now
    for box in boxes(data, at, len(data) if end is None else end):
        yield _timed(data, box) if box.kind in TIMED else box.unit()
        if box.kind == "meta":
            inner, items = heif_meta(data, box)
            for b in inner:
                if b.kind == "uuid":
                    yield from _uuid(data, b, now)
            for item, places in items:
                yield from _item(data, item, places, now)
        elif box.kind in CONTAINERS:
            yield from heic(data, box.body, box.stop, now)
