from __future__ import annotations

import struct

import media
import pytest
from media import box, chunk, element, riff, segment

from sieveworks.operators import inspect

SIMPLE = element("67C8", element("45A3", b"ARTIST"), element("4487", b"Jane\0"), element("67C8", element("45A3", b"SORT"), element("4485", b"\1\2")))
FILES = {
    "wav": ("wav", riff(b"WAVE", chunk(b"fmt ", bytes(16)), chunk(b"LIST", b"INFO" + chunk(b"INAM", "Ti\u200btle".encode() + b"\0")), chunk(b"id3 ", b"x"), chunk(b"data", b"s"))),
    "jpeg": ("jpeg", media.jpeg(segment(0xE1, b"Exif\0\0" + bytes(20)), segment(0xFE, b"a comment"), segment(0xE2, b"ICC_PROFILE..."))),
    "png": ("png", media.png((b"IHDR", bytes(13)), (b"tEXt", b"Title\0my title"), (b"zTXt", b"k\0\0zz"), (b"iTXt", b"k\0\0\0de\0\0hallo"), (b"tIME", b"\x07\xe8\1\2\3\4\5"), (b"eXIf", b"abc"), (b"vpAg", b"x"), (b"IDAT", b"p"), (b"IEND", b""))),
    "gif": ("gif", media.gif(b"\x21\xfe" + media.sub_blocks(b"note " * 100), media.gif_app(b"NETSCAPE2.0", b"\1\0\0"), media.GIF_IMAGE)),
    "webp": ("webp", riff(b"WEBP", chunk(b"VP8 ", b"img"), chunk(b"XMP ", b"<x:xmpmeta/>"))),
    "avi": ("avi", riff(b"AVI ", chunk(b"LIST", b"INFO" + chunk(b"IART", b"Jane")), chunk(b"DISP", b"d"), chunk(b"LIST", b"movi"))),
    "mp4": ("mp4", box(b"ftyp", b"isom\0\0\2\0") + box(b"moov", media.MVHD, box(b"udta", box(b"meta", bytes(4), box(b"ilst", box(b"\xa9nam", box(b"data", bytes(8), b"My film"))))))),
    "mkv": ("mkv", media.mkv(element("1549A966", element("7BA9", b"Film"), element("4461", struct.pack(">q", 725_760_000 * 10**9))), element("1254C367", element("7373", SIMPLE)), element("1941A469", element("61A7", element("466E", b"a.txt"), element("465C", b"123"))))),
    "raw": ("raw", media.camera_raw()),
    "cr3": ("cr3", media.cr3()),
    "heic": ("heic", media.heic()),
    "bad": ("png", b"\x89PNG\r\n\x1a\nbad"),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, v[0], bytearray(v[1])) for k, v in FILES.items()], "file string, format string, content binary")
    out: dict[str, list] = {}
    for r in sorted(inspect.fields(df, "file").collect(), key=lambda r: r.seq):
        out.setdefault(r.file, []).append(r)
    return out


def shown(rows, *names):
    return [tuple(r[n] for n in names) for r in rows]


def test_flat_formats(found):
    assert shown(found["wav"], "section", "name", "value", "size") == [("info", "INAM", "Title", 9), ("chunks", "id3", None, 1)]
    assert shown(found["jpeg"], "name", "kind", "value") == [("APP1", "exif", None), ("COM", "comment", "a comment"), ("APP2", "icc", "ICC_PROFILE...")]
    png = {r.section: r for r in found["png"]}
    assert (png["text"].name, png["text"].value) == ("Title", "my title") and png["compressedText"].size == 2
    assert png["translatedText"].value == "hallo" and png["translatedText"].detail == {"compressed": "false", "lang": "de"}
    assert png["time"].value == "2024-01-02 03:04:05" and png["exif"].size == 3 and png["chunks"].name == "vpAg"
    assert shown(found["gif"], "section", "name", "value") == [("comments", "", "note " * 100), ("apps", "NETSCAPE2.0", None)]
    assert shown(found["webp"], "name", "value") == [("XMP", "<x:xmpmeta/>")]
    assert shown(found["avi"], "section", "name", "value") == [("info", "IART", "Jane"), ("chunks", "DISP", None)]


def test_nested_formats(found):
    mp4 = found["mp4"]
    assert mp4[0].detail == {"version": "0", "creation": str(0x11223344), "modification": str(0x55667788)}
    assert (mp4[-1].place, mp4[-1].value) == ("udta/meta/ilst/?nam/data", "My film")
    assert shown(found["mkv"], "section", "place", "name", "value") == [("info", "", "title", "Film"), ("info", "", "dateUtc", None), ("tags", "ARTIST", "SORT", "(binary 2 bytes)"), ("tags", "", "ARTIST", "Jane"), ("attachments", "", "a.txt", None)]
    assert found["mkv"][1].detail["iso"] == "2024-01-01T00:00:00Z"
    raw = {(r.place, r.name): r for r in found["raw"]}
    assert raw["IFD0", "Artist"].value == "Jane Artist" and raw["IFD0", "MakerNote"].size == 20 and raw["IFD0", "XMP"].size == 17
    position = raw["GPS", "position"].detail
    assert float(position["latitude"]) == 48.5 and abs(float(position["longitude"]) - 11 - 5 / 60) < 1e-12 and "altitude" not in position
    assert [r.detail.get("kind") for r in found["cr3"] if r.name == "uuid"] == ["tiff", "xmp"] and len([r for r in found["cr3"] if r.section == "timestamps"]) == 3
    assert [(r.detail["type"], r.size) for r in found["heic"] if r.section == "items"][1:] == [("mime", 17), ("hvc1", 11)]
    assert any(r.place == "Exif/IFD0" and r.value == "Jane Artist" for r in found["heic"])
    assert "bad" not in found


def test_metadata_variant(spark):
    df = spark.createDataFrame([("a", "png", bytearray(FILES["png"][1]))], "file string, format string, content binary")
    row = inspect.metadata(df, "file").selectExpr("variant_get(metadata, '$.text[0].value', 'string') v").first()
    assert row.v == "my title"
