"""Media files for the tests, built byte by byte."""

from __future__ import annotations

import struct
import zlib


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def riff(form: bytes, *chunks: bytes) -> bytes:
    body = form + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def png_chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(*chunks: tuple[bytes, bytes]) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + b"".join(png_chunk(*c) for c in chunks)


def segment(code: int, data: bytes) -> bytes:
    return bytes([0xFF, code]) + struct.pack(">H", len(data) + 2) + data


def jpeg(*segments: bytes, scan: bytes = b"scan") -> bytes:
    return b"\xff\xd8" + b"".join(segments) + segment(0xDA, b"scanhd") + scan + b"\xff\xd9"


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


GIF_HEAD, GIF_GCE, GIF_IMAGE = b"GIF89a\x01\0\x01\0\0\0\0", b"\x21\xf9\x04\0\0\0\0\0", b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x01\x44\0"


def gif(*blocks: bytes, end: bytes = b";") -> bytes:
    return GIF_HEAD + b"".join(blocks) + end


def gif_app(name: bytes, data: bytes) -> bytes:
    return b"\x21\xff\x0b" + name + sub_blocks(data)


def box(name: bytes, *data: bytes) -> bytes:
    body = b"".join(data)
    return struct.pack(">I", 8 + len(body)) + name + body


MVHD = box(b"mvhd", bytes(4), bytes.fromhex("1122334455667788"), bytes(8))


def element(code: str, *data: bytes, unknown: bool = False) -> bytes:
    body = b"".join(data)
    return bytes.fromhex(code) + (b"\xff" if unknown else bytes([0x80 | len(body)])) + body


def mkv(*children: bytes) -> bytes:
    return element("1A45DFA3", b"\x42\x86\x81\1") + element("18538067", *children, unknown=True)


def tiff(entries: dict[int, tuple[int, object]], order: str = "<", exif=None, gps=None, sub=None, thumb: bytes = b"") -> bytes:
    """A TIFF with one directory and its sub-directories; values are bytes (type 2 or 7), or lists of longs or rationals."""
    place, later = 8, []

    def directory(at: int, items: dict[int, tuple[int, object]]) -> bytes:
        free, out, tail = at + 2 + 12 * len(items) + 4, b"", b""
        for tag, (kind, value) in sorted(items.items()):
            if kind == 5:
                data, n = b"".join(struct.pack(f"{order}II", *v) for v in value), len(value)
            elif kind == 4:
                data, n = b"".join(struct.pack(f"{order}I", v) for v in value), len(value)
            else:
                data, n = bytes(value), len(value)
            if len(data) > 4:
                out += struct.pack(f"{order}HHII", tag, kind, n, free + len(tail))
                tail += data + b"\0" * (len(data) % 2)
            else:
                out += struct.pack(f"{order}HHI", tag, kind, n) + data.ljust(4, b"\0")
        return struct.pack(f"{order}H", len(items)) + out + bytes(4) + tail

    main = dict(entries)
    for tag, items in ((34665, exif), (34853, gps), (330, sub)):
        if items is not None:
            main[tag] = (4, [0])
            later.append((tag, items))
    size = len(directory(place, main))
    at, parts = place + size, []
    for tag, items in later:
        main[tag] = (4, [at])
        items = dict(items)
        if tag == 330 and thumb:
            items |= {513: (4, [0]), 514: (4, [len(thumb)])}
            items[513] = (4, [at + len(directory(at, items))])
        part = directory(at, items) + (thumb if tag == 330 else b"")
        parts.append(part)
        at += len(part)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", place) + directory(place, main) + b"".join(parts)


THUMB = b"\xff\xd8" + segment(0xE1, b"Exif\0\0secret") + segment(0xDB, b"t") + b"\xff\xd9"


def camera_raw(order: str = "<") -> bytes:
    rational = lambda *v: (5, [(x, 1) for x in v])
    return tiff(
        {271: (2, b"Canon\0"), 315: (2, b"Jane Artist\0"), 33432: (2, b"(c) Secret\0"), 306: (2, b"2024:01:02 03:04:05\0"), 37500: (7, b"M" * 20), 700: (1, b"<x:xmpmeta>secret")},
        order,
        exif={36867: (2, b"2024:01:02 03:04:05\0"), 37510: (7, b"a comment"), 33437: rational(4)},
        gps={1: (2, b"N\0"), 2: rational(48, 30, 0), 3: (2, b"E\0"), 4: rational(11, 5, 0)},
        sub={315: (2, b"Sub Artist\0")},
        thumb=THUMB,
    )


def cr3(uuid: bytes = b"") -> bytes:
    trak = box(b"trak", box(b"tkhd", bytes(4), b"TIMETIME", bytes(4)), box(b"mdia", box(b"mdhd", bytes(4), b"TIMETIME", bytes(4))))
    inner = box(b"uuid", tiff({271: (2, b"Canon\0"), 315: (2, b"Jane Artist\0")}))
    xmp = box(b"uuid", b"<?xpacket begin secret")
    return box(b"ftyp", b"crx \0\0\0\1") + box(b"moov", MVHD, box(b"udta", b"secret"), inner, xmp, trak, uuid) + box(b"mdat", b"sensor")


def heic(located=(1, 2, 3)) -> bytes:
    exif = b"\0\0\0\6Exif\0\0" + tiff({271: (2, b"Canon\0"), 315: (2, b"Jane Artist\0")})
    xmp, image = b"<x:xmpmeta>secret", b"coded image"
    infe = lambda n, kind, more: box(b"infe", bytes([2, 0, 0, 0, 0, n, 0, 0]), kind, more)
    iinf = box(b"iinf", b"\0\0\0\0\0\3", infe(1, b"Exif", b"\0"), infe(2, b"mime", b"\0application/rdf+xml\0"), infe(3, b"hvc1", b"\0"))
    ftyp = box(b"ftyp", b"heic\0\0\0\0")

    def meta(at: int) -> bytes:
        places = {1: (at, len(exif)), 2: (at + len(exif), len(xmp)), 3: (at + len(exif) + len(xmp), len(image))}
        rows = b"".join(struct.pack(">HHHII", n, 0, 1, *places[n]) for n in located)
        return box(b"meta", bytes(4), box(b"pitm", b"\0\0\0\0\0\3"), iinf, box(b"iloc", b"\0\0\0\0\x44\0", struct.pack(">H", len(located)), rows))

    return ftyp + meta(len(ftyp) + len(meta(0)) + 8) + box(b"mdat", exif, xmp, image)
