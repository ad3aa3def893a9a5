from __future__ import annotations

import struct

import media
import pytest
from media import box, chunk, element, riff, segment
from pyspark.sql import functions as F

from sieveworks.operators import strip

FMT, DATA, INFO = chunk(b"fmt ", bytes(16)), chunk(b"data", b"sound!"), chunk(b"LIST", b"INFO" + chunk(b"INAM", b"title"))
DQT, SOF0 = segment(0xDB, b"tables"), segment(0xC0, b"frame")
IHDR, IDAT, IEND = (b"IHDR", bytes(13)), (b"IDAT", b"pixels"), (b"IEND", b"")
COMMENT, NETSCAPE = b"\x21\xfe" + media.sub_blocks(b"c" * 300), media.gif_app(b"NETSCAPE2.0", b"\1\0\0")
HDRL, MOVI = chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(12))), chunk(b"LIST", b"movi" + chunk(b"00dc", b"frame"))
FTYP, TRAK = box(b"ftyp", b"isom\0\0\2\0"), box(b"trak", box(b"mdia", box(b"mdhd", bytes(24))))
SCALE, CLUSTER = element("2AD7B1", b"\x0f\x42\x40"), element("1F43B675", b"\xe7\x81\0")
TITLE, DATE, APP, WRITER = element("7BA9", b"secret"), element("4461", bytes(8)), element("4D80", b"app"), element("5741", b"w")
TAGS, FILES, CRC = element("1254C367", b"secret"), element("1941A469", b"secret"), element("BF", b"crc!")
INFO_ELEMENT = element("1549A966", CRC, SCALE, TITLE, DATE, APP, WRITER)

#: name: (format, bytes, ids kept or None, ids dropped, is the result's size the input's?)
GOOD = {
    "wav": ("wav", riff(b"WAVE", FMT, DATA), ["fmt ", "data"], [], True),
    "wav info": ("wav", riff(b"WAVE", FMT, INFO, DATA), ["fmt ", "data"], ["LIST"], False),
    "wav others": ("wav", riff(b"WAVE", FMT, chunk(b"id3 ", b"abc"), chunk(b"bext", b""), DATA, chunk(b"iXML", b"x")), ["fmt ", "data"], ["id3 ", "bext", "iXML"], False),
    "wav no last pad": ("wav", riff(b"WAVE", FMT, chunk(b"data", b"odd"))[:-1], ["fmt ", "data"], [], False),
    "jpeg": ("jpeg", media.jpeg(DQT, SOF0), ["SOI", "DQT", "SOF0", "SOS"], [], True),
    "jpeg metadata": ("jpeg", media.jpeg(segment(0xE0, b"JFIF"), segment(0xE1, b"Exif\0\0secret"), DQT, b"\xff\xff" + segment(0xFE, b"secret"), SOF0), ["SOI", "DQT", "SOF0", "SOS"], ["APP0", "APP1", "COM"], False),
    "jpeg stuffed scan": ("jpeg", media.jpeg(segment(0xE1, b"x"), scan=b"a\xff\0b\xff\xe1"), ["SOI", "SOS"], ["APP1"], False),
    "jpeg without scan": ("jpeg", b"\xff\xd8" + DQT + segment(0xC3, b"") + b"\xff\xd9", ["SOI", "DQT", "MC3", "EOI"], [], True),
    "png": ("png", media.png(IHDR, (b"sRGB", b"\0"), IDAT, IEND), ["IHDR", "sRGB", "IDAT", "IEND"], [], True),
    "png metadata": ("png", media.png(IHDR, (b"tEXt", b"Title\0secret"), (b"iTXt", b""), (b"eXIf", b"x"), IDAT, (b"tIME", bytes(7)), IEND), ["IHDR", "IDAT", "IEND"], ["tEXt", "iTXt", "eXIf", "tIME"], False),
    "gif": ("gif", media.gif(media.GIF_GCE, NETSCAPE, media.GIF_IMAGE), ["HDR", "GCE", "NETSCAPE", "IMG", "TRL"], [], True),
    "gif metadata": ("gif", media.gif(COMMENT, media.gif_app(b"XMP DataXMP", b"secret"), media.GIF_IMAGE), ["HDR", "IMG", "TRL"], ["COMMENT", "APP-XMP Data"], False),
    "webp": ("webp", riff(b"WEBP", chunk(b"VP8 ", b"img")), ["VP8"], [], True),
    "webp metadata": ("webp", riff(b"WEBP", chunk(b"VP8X", bytes(10)), chunk(b"ICCP", b"i"), chunk(b"VP8 ", b"img"), chunk(b"EXIF", b"e"), chunk(b"XMP ", b"secret")), ["VP8X", "VP8"], ["ICCP", "EXIF", "XMP"], False),
    "avi": ("avi", riff(b"AVI ", HDRL, MOVI, chunk(b"idx1", b"i")), ["LIST-hdrl", "avih", "LIST-movi", "idx1"], [], True),
    "avi metadata": ("avi", riff(b"AVI ", HDRL, INFO, chunk(b"id3 ", b"secret!"), MOVI), ["LIST-hdrl", "avih", "LIST-movi"], ["LIST-INFO", "id3"], True),
    "mp4": ("mp4", FTYP + box(b"moov", media.MVHD, TRAK) + box(b"mdat", b"m"), ["moov", "mvhd", "trak", "mdia", "mdhd"], [], True),
    "mp4 metadata": ("mp4", FTYP + box(b"moov", media.MVHD, box(b"udta", b"secret"), box(b"meta", b"secret")) + box(b"uuid", b"secret"), ["moov", "mvhd"], ["udta", "meta", "uuid"], True),
    "mkv": ("mkv", media.mkv(element("1549A966", SCALE), CLUSTER), ["EBML", "Segment", "Info", "Info/TimestampScale", "Cluster"], [], True),
    "mkv metadata": ("mkv", media.mkv(INFO_ELEMENT, TAGS, FILES, CLUSTER), ["EBML", "Segment", "Info", "Info/TimestampScale", "Cluster"], ["Info/Title", "Info/DateUTC", "Info/MuxingApp", "Info/WritingApp", "Info/CRC-32", "Tags", "Attachments"], True),
    "raw": ("raw", media.camera_raw(), ["IFD0", "SubIFD", "ExifIFD", "GPS"], ["DateTime", "Artist", "Artist", "XMP", "Copyright", "DateTimeOriginal", "UserComment", "GPS", "THMB"], True),
    "raw big-endian": ("raw", media.camera_raw(">"), ["IFD0", "SubIFD", "ExifIFD", "GPS"], ["DateTime", "Artist", "Artist", "XMP", "Copyright", "DateTimeOriginal", "UserComment", "GPS", "THMB"], True),
    "cr3": ("cr3", media.cr3(), ["moov", "mvhd", "IFD0", "trak", "tkhd", "mdia", "mdhd"], ["udta", "Artist", "uuid-XMP"], True),
    "cr3 thumbnail": ("cr3", media.cr3(box(b"uuid", media.THUMB) + box(b"uuid", b"other")), ["moov", "mvhd", "IFD0", "trak", "tkhd", "mdia", "mdhd", "uuid"], ["udta", "Artist", "uuid-XMP", "uuid-JPEG"], True),
    "heic": ("heic", media.heic(), ["meta", "IFD0", "ITEM-hvc1"], ["Artist", "XMP"], True),
    "heic unplaced": ("heic", media.heic((2, 3)), ["meta", "ITEM-Exif", "ITEM-hvc1"], ["XMP"], True),
}
BAD = {
    "wav no fmt": ("wav", riff(b"WAVE", DATA)),
    "wav cut": ("wav", riff(b"WAVE", FMT, DATA)[:-2]),
    "wav RF64": ("wav", b"RF64" + riff(b"WAVE", FMT, DATA)[4:]),
    "wav trailing": ("wav", riff(b"WAVE", FMT, DATA) + b"abc"),
    "jpeg no SOI": ("jpeg", media.jpeg(DQT)[2:]),
    "jpeg no EOI": ("jpeg", media.jpeg(DQT)[:-2]),
    "jpeg cut": ("jpeg", b"\xff\xd8\xff\xdb\0\x20ab"),
    "png crc": ("png", media.png(IHDR, IDAT, IEND)[:-14] + b"!" + media.png(IHDR, IDAT, IEND)[-13:]),
    "png no IDAT": ("png", media.png(IHDR, IEND)),
    "png no IEND": ("png", media.png(IHDR, IDAT)),
    "png late IHDR": ("png", media.png(IDAT, IHDR, IEND)),
    "gif no trailer": ("gif", media.gif(media.GIF_IMAGE, end=b"")),
    "gif magic": ("gif", b"GIF88a" + media.gif()[6:]),
    "webp no image": ("webp", riff(b"WEBP", chunk(b"EXIF", b"e"))),
    "webp cut": ("webp", riff(b"WEBP", chunk(b"VP8 ", b"abcd"))[:-2]),
    "avi no movi": ("avi", riff(b"AVI ", HDRL)),
    "avi magic": ("avi", riff(b"AVIX", HDRL, MOVI)),
    "mp4 no ftyp": ("mp4", box(b"moov", media.MVHD)),
    "mp4 no moov": ("mp4", FTYP + box(b"mdat", b"m")),
    "mp4 box size": ("mp4", FTYP + b"\0\0\0\4moov"),
    "mkv no EBML": ("mkv", element("18538067", CLUSTER)),
    "mkv no Segment": ("mkv", element("1A45DFA3", b"\x42\x86\x81\1")),
    "raw magic": ("raw", b"II\x2b\0" + bytes(20)),
    "cr3 no moov": ("cr3", box(b"ftyp", b"crx \0\0\0\1") + box(b"mdat", b"")),
    "cr3 brand": ("cr3", box(b"ftyp", b"isom\0\0\0\1") + box(b"moov", b"")),
    "heic no meta": ("heic", box(b"ftyp", b"heic\0\0\0\0") + box(b"mdat", b"")),
    "heic brand": ("heic", box(b"ftyp", b"isom\0\0\0\0") + box(b"meta", bytes(4))),
    "empty": ("png", b""),
    "unknown": ("pdf", b"%PDF"),
    "null": ("wav", None),
}


@pytest.fixture(scope="module")
def stripped(spark):
    rows = [(k, v[0], None if v[1] is None else bytearray(v[1])) for k, v in (GOOD | BAD).items()]
    df = spark.createDataFrame(rows, "name string, format string, content binary")
    once = strip.strip(df).cache()
    again = strip.strip(once.select("name", "format", F.col("content_out").alias("content")).filter("content is not null"))
    return {r.name: r for r in once.collect()}, {r.name: r for r in again.collect()}, {r.name: r for r in strip.analyze(df).collect()}


@pytest.mark.parametrize("name", GOOD)
def test_good_files(stripped, name):
    first, second, _ = (x[name] for x in stripped)
    _, data, kept, dropped, same_size = GOOD[name]
    assert first.error is None
    assert sorted(p.id for p in first.dropped) == sorted(dropped)
    assert [p.id for p in first.kept] == kept or sorted(p.id for p in first.kept) == sorted(kept)
    out = bytes(first.content_out)
    assert (len(out) == len(data)) == same_size and first.bytes_saved == len(data) - len(out)
    assert b"secret" not in out and (b"Jane" not in out or name == "heic unplaced")
    if not dropped and same_size and name != "mp4":
        assert out == data
    assert bytes(second.content_out) == out
    if GOOD[name][0] not in ("raw", "cr3", "heic"):
        assert second.dropped == []


def test_bad_files(stripped):
    first, _, reports = stripped
    assert [k for k in BAD if not first[k].error or first[k].content_out is not None] == []
    assert first["unknown"].error == "unsupported format" and first["null"].error == "no content"
    assert {k: (r.error, r.bytes_out) for k, r in reports.items()} == {k: (r.error, r.bytes_out) for k, r in first.items()}


def test_details(stripped):
    first = stripped[0]
    out = lambda k: bytes(first[k].content_out)
    assert out("wav info") == riff(b"WAVE", FMT, DATA) and out("wav no last pad") == riff(b"WAVE", FMT, chunk(b"data", b"odd"))
    assert first["wav no last pad"].bytes_saved == -1
    assert out("jpeg metadata") == media.jpeg(DQT, SOF0)
    assert b"JUNK" in out("avi metadata") and struct.unpack_from("<I", out("avi metadata"), out("avi metadata").index(b"JUNK") + 4)[0] == len(INFO) - 8
    assert b"\x11\x22\x33\x44" not in out("mp4") and b"free" in out("mp4 metadata")
    assert out("mkv metadata").count(b"\xec") >= 7 and b"\x2a\xd7\xb1" in out("mkv metadata")
    for k in ("raw", "raw big-endian"):
        assert b"Canon" in out(k) and b"M" * 20 in out(k) and b"\xff\xd9" in out(k) and b"Secret" not in out(k)
    assert {p.id: p.size for p in first["raw"].dropped}["GPS"] == 2 + 24 + 2 + 24
    assert b"Canon" in out("heic") and b"coded image" in out("heic") and b"TIME" not in out("cr3")
    exif = media.heic((2, 3))
    assert b"Jane" in out("heic unplaced") and len(exif) == len(out("heic unplaced"))


def test_musical_chunks_stay_on_demand(spark):
    data = riff(b"WAVE", FMT, chunk(b"smpl", b"loops"), DATA)
    df = spark.createDataFrame([(1, "wav", bytearray(data))], "id long, format string, content binary")
    assert [p.id for p in strip.strip(df).first().dropped] == ["smpl"]
    row = strip.strip(df, keep_musical=True).first()
    assert row.dropped == [] and bytes(row.content_out) == data


def test_tables_and_lines(spark):
    df = spark.createDataFrame([(1, "wav", bytearray(GOOD["wav info"][1])), (2, "wav", bytearray(b"x"))], "id long, format string, content binary")
    parts = strip.parts_table(df, "id")
    policy = strip.policy_table(spark)
    joined = parts.drop("action", "how").join(F.broadcast(policy), ["format", "role"], "left")
    assert [(r.role, r.size) for r in parts.orderBy("seq").collect()] == [("fmt ", 16), ("LIST", 18), ("info", 5), ("data", 6)]
    assert joined.filter("role = 'data' and action = 'keep'").count() == 1
    lines = {r.id: r.line for r in strip.summary(strip.analyze(df), "id").collect()}
    assert lines[1].startswith("kept: fmt(16), data(6)\ndropped: LIST(18)\nbytes: ") and lines[2].startswith("FAIL file too small")
    short = {r.id: r.line for r in strip.summary(strip.analyze(df), "id", verbose=False).collect()}
    assert short[1] == "dropped 1 chunk(s), saved 26 bytes" and short[2].startswith("FAIL ")
    assert strip.strip(df.limit(0)).count() == 0
