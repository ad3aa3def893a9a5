"""Registered queries of metadata trees and of scrubbed VARIANT values, and their DuckDB SQL."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import sql
from sieveworks.operators import inspect, strip, variants
from sieveworks.operators.ranges import overlap_join
from sieveworks.plans.media import _head_sql, media_files
from sieveworks.sources import files, synth
from sieveworks.sources.shared import saved

Query = Callable[[SparkSession, str], DataFrame]
#: A zero width space, planted inside names and values.
ZW = "​"


def _made(spark: SparkSession, sf_dir: str, format: str, content: Column) -> DataFrame:
    files.bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.lit(format).alias("format"), content.alias("content"))


def _trees(made: DataFrame) -> DataFrame:
    return inspect.trees(made, "doc_id").select("doc_id", F.to_json("metadata").alias("metadata"))


_TEXT, _N = "coalesce(text, '')", "strlen(coalesce(text, ''))"
_SHOWN = _head_sql(_TEXT, inspect.PREVIEW)
_PREVIEW = f"CASE WHEN {_N} > 0 AND strlen(regexp_replace(left({_TEXT}, 65000), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) * 10 >= strlen(left({_TEXT}, 65000)) * 7 THEN {_SHOWN} END"


def mp4_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Films whose item list holds a name, the whole text as a comment, and that comment once more: boxes five deep."""
    name = synth.box(b"\xa9nam", synth.box(b"data", synth.raw(bytes(8)), synth.bytes_of(F.concat(F.lit(f"Fi{ZW}lm "), F.col("doc_id").cast("string")))))
    comment = synth.box(b"cmnt", synth.box(b"data", synth.raw(bytes(8)), synth.bytes_of(F.col("text"))))
    meta = synth.box(b"meta", synth.raw(bytes(4)), synth.box(b"ilst", name, comment, comment))
    moov = synth.box(b"moov", synth.box(b"mvhd", synth.raw(synth.MVHD)), synth.box(b"udta", meta))
    content = F.concat(synth.box(b"ftyp", synth.raw(b"isom\0\0\2\0")), moov, synth.box(b"mdat", synth.raw(b"film")))
    return _trees(_made(spark, sf_dir, "mp4", content))


def _mp4_sql() -> str:
    def box(kind: str, size: str, kids: str) -> str:
        return f"""'{{"children":[' || {kids} || '],"size":' || ({size})::varchar || ',"type":"{kind}"}}'"""

    comment = box("cmnt", "n + 24", """'{"size":' || (n + 16)::varchar || ',"text":' || coalesce(to_json(shown)::varchar, 'null') || ',"type":"data"}'""")
    name = box("?nam", "m + 24", """'{"size":' || (m + 16)::varchar || ',"text":"Film ' || doc_id || '","type":"data"}'""")
    ilst = box("ilst", "m + 2 * n + 80", f"{name} || ',' || {comment} || ',' || {comment}")
    udta = box("udta", "m + 2 * n + 100", box("meta", "m + 2 * n + 92", ilst))
    return f"""SELECT doc_id, '{{"boxes":[' || {udta} || '],"timestamps":[{{"box":"mvhd","creation":287454020,"modification":1432778632,"version":0}}]}}' AS metadata
        FROM (SELECT doc_id, {_N}::bigint AS n, 8 + strlen(doc_id::varchar) AS m, {_PREVIEW} AS shown FROM documents)"""


def mkv_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags in tags, an attachment and a title, with a zero width space in names, MIME types and values."""
    ebml, said = synth.ebml, lambda s: synth.bytes_of(F.concat(F.lit(s), F.col("doc_id").cast("string")))
    info = ebml(b"\x15\x49\xa9\x66", ebml(b"\x7b\xa9", synth.bytes_of(F.col("text"))))
    inner = ebml(b"\x67\xc8", F.concat(ebml(b"\x45\xa3", synth.raw(f"SO{ZW}RT".encode())), ebml(b"\x44\x85", synth.bytes_of(F.col("text")))))
    simple = ebml(b"\x67\xc8", F.concat(ebml(b"\x45\xa3", synth.raw(f"ART{ZW}IST".encode())), ebml(b"\x44\x87", said(f"Ja{ZW}ne ")), inner, inner))
    file = F.concat(ebml(b"\x46\x6e", said(f"na{ZW}me.")), ebml(b"\x46\x60", synth.raw(f"font/{ZW}ttf".encode())), ebml(b"\x46\x5c", synth.bytes_of(F.col("text"))))
    parts = (info, ebml(b"\x12\x54\xc3\x67", ebml(b"\x73\x73", simple)), ebml(b"\x19\x41\xa4\x69", ebml(b"\x61\xa7", file)), ebml(b"\x1f\x43\xb6\x75", synth.raw(b"\xe7\x81\0")))
    content = F.concat(ebml(b"\x1a\x45\xdf\xa3", synth.raw(b"\x42\x86\x81\1")), synth.raw(b"\x18\x53\x80\x67\xff"), *parts)
    return _trees(_made(spark, sf_dir, "mkv", content))


_MKV_SQL = f"""SELECT doc_id, '{{"attachments":[{{"description":null,"file":"name.' || doc_id || '","mime":"font/ttf","size":' || n || '}}],"info":{{"title":' || to_json(shown)::varchar
        || '}},"tags":[{{"tag":"ARTIST/SORT","value":"(binary ' || n || ' bytes)"}},{{"tag":"ARTIST/SORT","value":"(binary ' || n || ' bytes)"}},{{"tag":"ARTIST","value":"Jane ' || doc_id || '"}}]}}' AS metadata
        FROM (SELECT doc_id, {_N} AS n, {_head_sql(f"rtrim({_TEXT}, ' ' || chr(0))", inspect.LONGEST)} AS shown FROM documents)"""


def png_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and a language with a zero width space, before the whole text."""
    image = (synth.png_chunk(b"IDAT", synth.raw(b"x")), synth.png_chunk(b"IEND", synth.raw(b"")))
    text = synth.png_chunk(b"tEXt", F.concat(synth.raw(f"Ti{ZW}tle\0".encode()), synth.bytes_of(F.col("text"))))
    other = synth.png_chunk(b"iTXt", F.concat(synth.raw(f"k{ZW}ey\0\0\0e{ZW}n\0\0".encode()), synth.bytes_of(F.col("text"))))
    content = F.concat(synth.raw(b"\x89PNG\r\n\x1a\n"), synth.png_chunk(b"IHDR", synth.raw(bytes(13))), text, other, *image)
    return _trees(_made(spark, sf_dir, "png", content))


_PNG_SQL = f"""SELECT doc_id, '{{"chunks":[],"compressedText":[],"exif":[],"profiles":[],"text":[{{"keyword":"Title","text":' || shown || '}}],"time":null,"translatedText":[{{"compressed":false,"keyword":"key","lang":"en","text":' || shown || '}}]}}' AS metadata
        FROM (SELECT doc_id, to_json({_head_sql(_TEXT, inspect.LONGEST)})::varchar AS shown FROM documents)"""


def _directory(entries: list[tuple[int, int, int, object]], after: int = 0) -> bytes:
    """A big-endian TIFF directory of (tag, type, count, value); a value is four bytes or an offset."""
    rows = b"".join(struct.pack(">HHI", tag, kind, n) + (v if isinstance(v, bytes) else struct.pack(">I", v)) for tag, kind, n, v in entries)
    return struct.pack(">H", len(entries)) + rows + struct.pack(">I", after)


#: Places of the directories of raw_tree: the first, two equal sub-directories, Exif, GPS, the next of the chain; then offsets and rationals.
_MAIN, _SUBS, _EXIF, _GPS, _NEXT, _LIST, _RATIOS = 8, (98, 128), 158, 176, 230, 248, 260
_ARTIST = 308


def raw_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big-endian camera files: the text as Artist, sub-directories (one offset twice), Exif, a GPS position and a chained directory."""
    artist = F.concat(F.rpad(synth.bytes_of(F.col("text")), F.greatest(F.octet_length(synth.bytes_of(F.col("text"))), F.lit(4)).cast("int"), synth.raw(b" ")), synth.raw(b"\0"))
    main = _directory([(315, 2, 0, _ARTIST), (330, 4, 3, _LIST), (700, 1, 4, b"<x:>"), (34665, 4, 1, _EXIF), (34853, 4, 1, _GPS), (37500, 7, 4, b"note")], _NEXT)
    sub = _directory([(315, 2, 4, b"Sub\0"), (306, 2, 4, b"now\0")])
    gps = _directory([(1, 2, 2, b"S\0\0\0"), (2, 5, 3, _RATIOS), (3, 2, 2, b"E\0\0\0"), (4, 5, 3, _RATIOS + 24)])
    fixed = {_MAIN: main, _SUBS[0]: sub, _SUBS[1]: sub, _EXIF: _directory([(36867, 2, 4, b"day\0")]), _GPS: gps, _NEXT: _directory([(271, 2, 4, b"Mke\0")]), _LIST: struct.pack(">III", _SUBS[0], _SUBS[1], _SUBS[0])}
    layout = bytearray(_RATIOS)
    layout[:8] = b"MM\0*" + struct.pack(">I", _MAIN)
    for at, part in fixed.items():
        assert not any(layout[at : at + len(part)]), "directories overlap"
        layout[at : at + len(part)] = part
    count = _MAIN + 2 + 4  # of the Artist entry
    i = F.col("doc_id")
    ratios = [(i % 90, 1), (i % 60, 1), (i % 6000, 100), (i % 180, 1), (i % 60, 1), (i % 6000, 100)]
    gps_values = [x for a, b in ratios for x in (synth.be32(a), synth.be32(F.lit(b)))]
    content = F.concat(synth.raw(bytes(layout[:count])), synth.be32(F.octet_length(artist).cast("long")), synth.raw(bytes(layout[count + 4 :])), *gps_values, artist)
    found = inspect.trees(_made(spark, sf_dir, "raw", content), "doc_id")
    at = lambda path, kind: F.variant_get("metadata", f"$.ifds[0]{path}", kind)
    position = [F.round(at(f".gps.{k}", "double"), 9).alias(k) for k in ("latitude", "longitude")]
    tags = [at(f".subIfds[{k}]", "variant").cast("string").alias(f"sub_{k}") for k in range(5)]
    return found.select("doc_id", at(".tags.Artist", "string").alias("artist"), at(".xmp", "long").alias("xmp"), at(".makerNote", "long").alias("maker_note"), *position, *tags, at(".subIfds[5]", "string").alias("sub_5"))


def _raw_sql() -> str:
    empty = '"gps":null,"id":"{}","makerNote":null,"tags":{},"xmp":null'
    node = lambda name, tags: "'{" + empty.replace("{}", name, 1).replace('"tags":{}', f'"tags":{tags}') + "}'"
    sub = node("SubIFD", '{"Artist":"Sub","DateTime":"now"}')
    subs = [sub, sub, node("SubIFD", "{}"), node("ExifIFD", '{"DateTimeOriginal":"day"}'), node("IFD1", '{"Make":"Mke"}')]
    degrees = lambda a, sign: f"round({sign}((doc_id % {a})::double + (doc_id % 60)::double / 60 + (doc_id % 6000)::double / 100 / 3600), 9)"
    return f"""SELECT doc_id, shown AS artist, 4::bigint AS xmp, 4::bigint AS maker_note, {degrees(90, "-")} AS latitude, {degrees(180, "")} AS longitude,
        {", ".join(f"{s} AS sub_{k}" for k, s in enumerate(subs))}, NULL::varchar AS sub_5
        FROM (SELECT doc_id, {_head_sql(f"rtrim({_TEXT}, ' ' || chr(0))", inspect.LONGEST)} AS shown FROM documents)"""


def json_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.props as VARIANT inside planted objects and arrays: strings lose their zero width spaces, keys keep theirs."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = variants.quoted(F.concat(F.substr("event_type", F.lit(1), F.lit(2)), F.when(F.col("event_id") % 3 > 0, ZW).otherwise(""), F.substr("event_type", F.lit(3), F.lit(99))))
    json = F.concat(F.lit(f'{{"a{ZW}":['), kind, F.lit(',[{"p":'), F.col("props"), F.lit(f',"s":"{ZW}"}}],null,'), (F.col("event_id") % 7).cast("string"), F.lit('],"b":{"c":'), kind, F.lit("}}"))
    values = events.select("event_id", F.parse_json(F.coalesce(json, F.lit("null"))).alias("props"))
    return variants.scrub(values, "props").select("event_id", F.to_json("props").alias("props"))


_JSON_SQL = f"""SELECT event_id, '{{"a{ZW}":[' || to_json(event_type)::varchar || ',[{{"p":' || replace(props, ' ', '') || ',"s":' || '""' || '}}],null,' || (event_id % 7)::varchar || '],"b":{{"c":' || to_json(event_type)::varchar || '}}}}' AS props FROM events"""

def chunks_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and bytes of every document's WAV file by role and action, in SQL alone: a table function under LATERAL and the policies."""
    sql.register(spark)
    media_files(spark, sf_dir, "wav").createOrReplaceTempView("wav_files")
    return spark.sql("""
        SELECT c.role, p.action, count(*) AS parts, sum(c.size) AS bytes, count(DISTINCT f.doc_id) AS files
        FROM wav_files f, LATERAL chunks_of(f.format, f.content) c
        LEFT JOIN strip_policy p ON p.format = 'wav' AND p.role = c.role
        GROUP BY c.role, p.action""")


_LATERAL_SQL = f"""
SELECT role, action, count(*) AS parts, sum(size)::bigint AS bytes, count(DISTINCT doc_id) AS files FROM (
    SELECT doc_id, unnest([{{'role': 'fmt ', 'action': 'keep', 'size': 16}}, {{'role': 'LIST', 'action': NULL, 'size': 12 + n + n % 2}}, {{'role': 'info', 'action': NULL, 'size': n}}, {{'role': 'data', 'action': 'keep', 'size': m}}], recursive := true)
    FROM (SELECT doc_id, {_N}::bigint AS n, strlen(concat_ws('/', lang, source))::bigint AS m FROM documents)) GROUP BY role, action"""

def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which boxes of every document's film lie in which others, by a join of their byte ranges."""
    parts = saved(strip.parts_table(media_files(spark, sf_dir, "mp4"), "doc_id").select("doc_id", "seq", "id", "start", "stop"), "box-ranges")
    pairs = overlap_join(parts, parts, ["doc_id"]).filter("l.seq < r.seq")
    inside = (F.col("r.start") >= F.col("l.start")) & (F.col("r.stop") <= F.col("l.stop"))
    return pairs.groupBy(F.col("l.id").alias("outer_box"), F.col("r.id").alias("inner_box"), inside.alias("inside")).agg(F.count("*").alias("pairs"), F.sum(F.col("r.stop") - F.col("r.start")).alias("bytes"))


_BOXES_SQL = f"""
SELECT 'moov' AS outer_box, 'mvhd' AS inner_box, true AS inside, count(*) AS pairs, (32 * count(*))::bigint AS bytes FROM documents HAVING count(*) > 0
UNION ALL SELECT 'moov', 'udta', true, count(*), sum(8 + {_N})::bigint FROM documents HAVING count(*) > 0"""

QUERIES: dict[str, Query] = {"box_overlaps": box_overlaps, "chunks_lateral": chunks_lateral, "mp4_tree": mp4_tree, "mkv_tree": mkv_tree, "png_tree": png_tree, "raw_tree": raw_tree, "json_scrub": json_scrub}
ORACLE_SQL = {"box_overlaps": _BOXES_SQL, "chunks_lateral": _LATERAL_SQL, "mp4_tree": _mp4_sql(), "mkv_tree": _MKV_SQL, "png_tree": _PNG_SQL, "raw_tree": _raw_sql(), "json_scrub": _JSON_SQL}
