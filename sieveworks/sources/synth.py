"""Small media files made from a text column by SQL functions: inputs whose parts are known without parsing them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.operators.strip import le32


def raw(data: bytes) -> Column:
    return F.lit(bytearray(data))


def be32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 8, "0"))


def be16(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 4, "0"))


def bytes_of(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def _n(data: Column) -> Column:
    return F.octet_length(data).cast("long")


def riff_chunk(name: bytes, data: Column) -> Column:
    pad = F.when(_n(data) % 2 == 1, raw(b"\0")).otherwise(raw(b""))
    return F.concat(raw(name), le32(_n(data)), data, pad)


def riff(form: bytes, *chunks: Column) -> Column:
    body = F.concat(raw(form), *chunks)
    return F.concat(raw(b"RIFF"), le32(_n(body)), body)


def wav(text: Column, sound: Column) -> Column:
    info = F.concat(raw(b"INFO"), riff_chunk(b"INAM", bytes_of(text)))
    return riff(b"WAVE", riff_chunk(b"fmt ", raw(bytes(16))), riff_chunk(b"LIST", info), riff_chunk(b"data", sound))


def webp(text: Column, image: Column) -> Column:
    return riff(b"WEBP", riff_chunk(b"VP8 ", image), riff_chunk(b"XMP ", bytes_of(text)))


def avi(text: Column, video: Column) -> Column:
    header = F.concat(raw(b"hdrl"), riff_chunk(b"avih", raw(bytes(12))))
    info = F.concat(raw(b"INFO"), riff_chunk(b"INAM", bytes_of(text)))
    movi = F.concat(raw(b"movi"), riff_chunk(b"00dc", video))
    return riff(b"AVI ", riff_chunk(b"LIST", header), riff_chunk(b"LIST", info), riff_chunk(b"LIST", movi))


def png_chunk(name: bytes, data: Column) -> Column:
    body = F.concat(raw(name), data)
    return F.concat(be32(_n(data)), body, be32(F.crc32(body)))


def png(text: Column, image: Column) -> Column:
    title = F.concat(raw(b"Title\0"), bytes_of(text))
    return F.concat(raw(b"\x89PNG\r\n\x1a\n"), png_chunk(b"IHDR", raw(bytes(13))), png_chunk(b"tEXt", title), png_chunk(b"IDAT", image), png_chunk(b"IEND", raw(b"")))


#: Bytes of text in one APP1 segment, which holds 65,527 at most.
SEGMENT = 65_000


def jpeg(text: Column, scan: Column) -> Column:
    """The text goes into APP1 segments of up to SEGMENT bytes; one at least."""
    data = bytes_of(text)
    starts = F.sequence(F.lit(1), F.greatest(_n(data), F.lit(1)).cast("int"), F.lit(SEGMENT))
    parts = F.transform(starts, lambda k: F.concat(raw(b"Exif\0\0"), F.substr(data, k, F.lit(SEGMENT))))
    segments = F.transform(parts, lambda p: F.concat(raw(b"\xff\xe1"), be16(_n(p) + 2), p))
    app1 = F.aggregate(segments, raw(b""), lambda a, b: F.concat(a, b))
    return F.concat(raw(b"\xff\xd8"), app1, raw(b"\xff\xc0\0\x07ABCDE\xff\xda\0\x08scanhd"), scan, raw(b"\xff\xd9"))


def sub_blocks(data: Column) -> Column:
    """A chain of GIF sub-blocks of up to 255 bytes."""
    starts = F.sequence(F.lit(1), F.greatest(_n(data), F.lit(1)).cast("int"), F.lit(255))
    blocks = F.transform(starts, lambda k: F.concat(F.unhex(F.lpad(F.hex(_n(F.substr(data, k, F.lit(255)))), 2, "0")), F.substr(data, k, F.lit(255))))
    return F.concat(F.aggregate(blocks, raw(b""), lambda a, b: F.concat(a, b)), raw(b"\0"))


def gif(text: Column) -> Column:
    """The text, which must not be empty, is the comment."""
    return F.concat(raw(b"GIF89a\x01\0\x01\0\0\0\0"), raw(b"\x21\xfe"), sub_blocks(bytes_of(text)), raw(b"\x21\xf9\x04\0\0\0\0\0"), raw(b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x01\x44\0"), raw(b";"))


def box(name: bytes, *data: Column) -> Column:
    body = reduce(lambda a, b: F.concat(a, b), data, raw(b""))
    return F.concat(be32(_n(body) + 8), raw(name), body)


MVHD = bytes(4) + bytes.fromhex("1122334455667788") + bytes(12)


def mp4(text: Column, media: Column) -> Column:
    return F.concat(box(b"ftyp", raw(b"isom\0\0\2\0")), box(b"moov", box(b"mvhd", raw(MVHD)), box(b"udta", bytes_of(text))), box(b"mdat", media))


def cr3(text: Column, media: Column) -> Column:
    return F.concat(box(b"ftyp", raw(b"crx \0\0\0\1")), box(b"moov", box(b"mvhd", raw(MVHD)), box(b"udta", bytes_of(text))), box(b"mdat", media))


def ebml(code: bytes, data: Column) -> Column:
    """An element with an 8-byte size."""
    return F.concat(raw(code + b"\1"), F.unhex(F.lpad(F.hex(_n(data)), 14, "0")), data)


def mkv(text: Column) -> Column:
    info = F.concat(ebml(b"\x2a\xd7\xb1", raw(b"\x0f\x42\x40")), ebml(b"\x7b\xa9", bytes_of(text)))
    return F.concat(ebml(b"\x1a\x45\xdf\xa3", raw(b"\x42\x86\x81\1")), raw(b"\x18\x53\x80\x67\xff"), ebml(b"\x15\x49\xa9\x66", info), ebml(b"\x12\x54\xc3\x67", bytes_of(text)), ebml(b"\x1f\x43\xb6\x75", raw(b"\xe7\x81\0")))


def tiff(text: Column) -> Column:
    """Big-endian: Make and Artist, the latter the text and a NUL, of five bytes at least."""
    artist = F.concat(F.rpad(bytes_of(text), F.greatest(_n(bytes_of(text)), F.lit(4)).cast("int"), raw(b" ")), raw(b"\0"))
    entries = F.concat(raw(b"\0\2" + b"\x01\x0f\0\2\0\0\0\6\0\0\0\x26" + b"\x01\x3b\0\2"), be32(_n(artist)), raw(b"\0\0\0\x2c" + bytes(4)))
    return F.concat(raw(b"MM\0*\0\0\0\x08"), entries, raw(b"Canon\0"), artist)


def heic(text: Column, image: Column) -> Column:
    """An XMP item with the text and an hvc1 item with the image, placed by file offsets."""
    xmp = bytes_of(text)
    items = (box(b"infe", raw(b"\2\0\0\0\0\1\0\0mime\0application/rdf+xml\0")), box(b"infe", raw(b"\2\0\0\0\0\2\0\0hvc1\0")))
    iinf = box(b"iinf", raw(b"\0\0\0\0\0\2"), *items)
    pitm = box(b"pitm", raw(b"\0\0\0\0\0\2"))
    ftyp = box(b"ftyp", raw(b"heic\0\0\0\0"))

    def iloc(at: Column) -> Column:
        one = lambda number, place, data: F.concat(raw(bytes([0, number, 0, 0, 0, 1])), be32(place), be32(_n(data)))
        return box(b"iloc", raw(b"\0\0\0\0\x44\0\0\2"), one(1, at, xmp), one(2, at + _n(xmp), image))

    def head(at: Column) -> Column:
        return F.concat(ftyp, box(b"meta", raw(bytes(4)), pitm, iinf, iloc(at)))

    return F.concat(head(_n(head(F.lit(0))) + 8), box(b"mdat", xmp, image))
