from __future__ import annotations

import json
import struct

import media
import pytest
from media import box, element
from pyspark.sql import functions as F
from test_inspect import FILES

from sieveworks.operators import inspect, variants

ZW = "​"


def ifd(entries, after=0, order="<"):
    out = b"".join(struct.pack(f"{order}HHI", t, k, n) + (v if isinstance(v, bytes) else struct.pack(f"{order}I", v)) for t, k, n, v in entries)
    return struct.pack(f"{order}H", len(entries)) + out + struct.pack(f"{order}I", after)


#: A directory whose chain comes back to itself, and whose sub-directory lies beyond the file.
LOOP = b"II*\0\x08\0\0\0" + ifd([(315, 2, 4, b"one\0"), (315, 2, 4, b"two\0"), (330, 4, 1, 9999)], 8)
SIMPLE = element("67C8", element("45A3", f"A{ZW}B".encode()), element("67C8", element("45A3", "Ü".encode()), element("67C8", element("45A3", b"C"), element("4487", f"v{ZW}".encode()))), element("67C8", element("4487", b"nameless")))
DEEP = box(b"udta", box(b"aaaa", box(b"bbbb", box(b"cccc", b"text"), box(b"cccc", b"text")), box(b"dddd", f"x{ZW}y".encode())))
MORE = {
    "loop": ("raw", LOOP),
    "deep": ("mp4", box(b"ftyp", b"isom\0\0\2\0") + box(b"moov", media.MVHD, DEEP, box(b"uuid", bytes(20)))),
    "tags": ("mkv", media.mkv(element("1254C367", element("7373", SIMPLE)), element("1941A469", element("61A7", element("466E", f"na{ZW}me".encode()), element("4660", b"\xff\xfe"), element("467E", b"d\0 "))))),
    "twice": ("wav", media.riff(b"WAVE", media.chunk(b"fmt ", bytes(16)), media.chunk(b"LIST", b"INFO" + media.chunk(b"INAM", b"a") + media.chunk(b"IART", b"c") + media.chunk(b"INAM", b"b")), media.chunk(b"data", b"s"))),
    "plain": ("wav", media.riff(b"WAVE", media.chunk(b"fmt ", bytes(16)), media.chunk(b"data", b"s"))),
}


@pytest.fixture(scope="module")
def found(spark):
    files = FILES | MORE
    df = spark.createDataFrame([(k, v[0], bytearray(v[1])) for k, v in files.items()], "file string, format string, content binary").repartition(3)
    return {r.file: json.loads(r.m) for r in inspect.trees(df, "file").select("file", F.to_json("metadata").alias("m")).collect()}


def test_boxes(found):
    boxes = found["deep"]["boxes"]
    leaf = {"type": "cccc", "size": 12, "text": "text"}
    inner = {"type": "bbbb", "size": 32, "children": [leaf, leaf]}
    assert boxes[0] == {"type": "udta", "size": boxes[0]["size"], "children": [{"type": "aaaa", "size": boxes[0]["size"] - 8, "children": [inner, {"type": "dddd", "size": 8 + 5, "text": "xy"}]}]}
    assert boxes[1]["type"] == "uuid" and len(found["deep"]["timestamps"]) == 1
    assert found["mp4"]["boxes"][0]["children"][0]["children"][0]["children"][0]["children"][0]["text"] == "My film"


def test_directories(found):
    raw = found["raw"]["ifds"][0]
    assert raw["tags"]["Artist"] == "Jane Artist" and raw["makerNote"] == 20 and raw["gps"]["latitude"] == 48.5
    assert [x["id"] for x in raw["subIfds"]] == ["SubIFD", "ExifIFD"]
    # the last of two tags counts; a directory met before, or beyond the file, is there without tags
    loop = found["loop"]["ifds"][0]
    empty = {"tags": {}, "gps": None, "makerNote": None, "xmp": None}
    assert loop["tags"] == {"Artist": "two"} and loop["subIfds"] == [{"id": "SubIFD"} | empty, {"id": "IFD1"} | empty]
    assert found["cr3"]["boxes"][1]["tiff"]["ifds"][0]["tags"]["Artist"] == "Jane Artist" and "tiff" not in found["cr3"]["boxes"][2]
    assert found["heic"]["exif"]["byteOrder"] == "II" and found["heic"]["items"][1]["contentType"] == "application/rdf+xml"


def test_tags_and_attachments(found):
    assert [(x["tag"], x["value"]) for x in found["tags"]["tags"]] == [("AB/Ü/C", "v"), ("AB/Ü", ""), ("AB", "")]
    assert found["tags"]["attachments"] == [{"file": "name", "mime": "??", "size": 0, "description": "d"}]
    assert found["mkv"]["info"]["dateUtc"] == {"ns": 725_760_000 * 10**9, "iso": "2024-01-01T00:00:00Z"}


def test_flat_shapes(found):
    assert found["twice"] == {"info": {"INAM": "b", "IART": "c"}, "chunks": []} and found["plain"] == {"info": {}, "chunks": []}
    assert found["png"] == {"text": [{"keyword": "Title", "text": "my title"}], "compressedText": [{"keyword": "k", "method": 0, "size": 2}], "translatedText": [{"keyword": "k", "compressed": False, "lang": "de", "text": "hallo"}], "profiles": [], "exif": [{"size": 3}], "time": "2024-01-02 03:04:05", "chunks": [{"type": "vpAg", "size": 1}]}
    assert found["gif"]["comments"] == ["note " * 100] and found["gif"]["apps"][0]["id"] == "NETSCAPE2.0"
    assert "bad" not in found


def test_fields_scrub_names_and_details(spark):
    df = spark.createDataFrame([("t", "mkv", bytearray(MORE["tags"][1]))], "file string, format string, content binary")
    rows = inspect.fields(df, "file").collect()
    attachment = next(r for r in rows if r.section == "attachments")
    assert (attachment.name, attachment.detail["file"], attachment.detail["mime"]) == ("name", "name", "??")
    assert [r.name for r in rows if r.section == "tags"] == ["C", "Ü", "AB"]


def test_trees_of_nothing(spark):
    none = spark.createDataFrame([], "file string, format string, content binary")
    assert inspect.trees(none, "file").collect() == []


def plain_scrub(value):
    if isinstance(value, str):
        return value.replace(ZW, "")
    if isinstance(value, list):
        return [plain_scrub(x) for x in value]
    return {k: plain_scrub(v) for k, v in value.items()} if isinstance(value, dict) else value


def test_scrub(spark):
    deep = f"bottom{ZW}"
    for k in range(30):
        deep = {f"k{ZW}{k}": deep} if k % 2 else [deep, {}, [], None, k]
    values = [{f"a{ZW}": f"b{ZW}", "q": f'quote " \\ {ZW} [ {{ ,:'}, f"s{ZW}", [f"{ZW}", ZW, "plain", 1.5, True, None], {"none": ["é", {}]}, 7, "", [], deep, None]
    rows = [(k % 3, json.dumps(v, ensure_ascii=False)) for k, v in enumerate(values)] + [(None, json.dumps(values[0]))] * 20 + [(9, None)]
    df = spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("a.b"), F.col("j").alias("json")).repartition(3)
    got = variants.scrub(df, "a.b").select("id", "json", F.to_json(F.col("`a.b`")).alias("out")).collect()
    assert sorted((r.id or -1, r.json or "") for r in got) == sorted((a or -1, b or "") for a, b in rows)
    for r in got:
        assert (r.out is None) == (r.json is None) and (r.out is None or json.loads(r.out) == plain_scrub(json.loads(r.json)))
    assert variants.scrub(df.limit(0), "a.b").collect() == []
