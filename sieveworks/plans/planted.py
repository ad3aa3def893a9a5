"""Registered queries of files whose parts overlap, point at each other or fail in part, made from every document's
whole text, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import inspect, strip
from sieveworks.plans.trees import _made
from sieveworks.sources import synth

Query = Callable[[SparkSession, str], DataFrame]

#: n: bytes of the text; g: of the text as a tag's value without its NUL; s: of its APP1 segments; m: of lang and source.
_BYTES = f"""(SELECT *, greatest(n, 4) AS g, greatest(1, (n + {synth.SEGMENT - 1}) // {synth.SEGMENT}) AS s
    FROM (SELECT doc_id, strlen(coalesce(text, ''))::bigint AS n, strlen(concat_ws('/', lang, source))::bigint AS m FROM documents))"""


def _scan() -> Column:
    return synth.bytes_of(F.concat_ws("/", "lang", "source"))


def _report(files: DataFrame) -> DataFrame:
    out = strip.analyze(files)
    return out.select("doc_id", "error", strip.listed(F.col("kept")).alias("kept"), strip.listed(F.col("dropped")).alias("dropped"), "bytes_saved")


def _report_sql(kept: str, dropped: str) -> str:
    return f"SELECT doc_id, NULL::varchar AS error, {kept} AS kept, {dropped} AS dropped, 0::bigint AS bytes_saved FROM {_BYTES}"


def _number(n: Column | int, size: int, order: str) -> Column:
    digits = F.lpad(F.hex(F.lit(n) if isinstance(n, int) else n), 2 * size, "0")
    return F.unhex(digits if order == ">" else F.concat(*(F.substr(digits, F.lit(2 * k + 1), F.lit(2)) for k in reversed(range(size)))))


def _entry(order: str, tag: int, kind: int, count: Column | int, value: Column | int) -> Column:
    """A directory entry; the value is an offset, or four bytes as they are."""
    return F.concat(_number(tag, 2, order), _number(kind, 2, order), _number(count, 4, order), value if isinstance(value, Column) else _number(value, 4, order))


def _directory(order: str, *entries: Column) -> Column:
    return F.concat(_number(len(entries), 2, order), *entries, synth.raw(bytes(4)))


def _head(order: str) -> Column:
    return F.concat(synth.raw(b"II*\0" if order == "<" else b"MM\0*"), _number(8, 4, order))


def _either(even: Column, odd: Column) -> Column:
    return F.when(F.col("doc_id") % 2 == 0, even).otherwise(odd)


def _artist() -> Column:
    """The text, padded to four bytes."""
    data = synth.bytes_of(F.col("text"))
    return F.rpad(data, F.greatest(F.octet_length(data), F.lit(4)), synth.raw(b" "))


def _camera(order: str) -> Column:
    """A maker, the text as the artist, a GPS directory made from doc_id and a thumbnail with the text in its segments."""
    i, u32 = F.col("doc_id"), lambda n: _number(n, 4, order)
    degrees = lambda d, m, s: F.concat(u32(d), u32(1), u32(m), u32(1), u32(s), u32(100))
    thumb = synth.jpeg(F.col("text"), _scan())
    # 8 head, 62 maker's name, 68 GPS with its numbers from 122 and 146 on, 170 sub-directory, 200 thumbnail, then the artist
    main = _directory(
        order,
        _entry(order, 271, 2, 6, 62),
        _entry(order, 315, 2, F.octet_length(_artist()) + 1, _number(F.octet_length(thumb) + 200, 4, order)),
        _entry(order, 330, 4, 1, 170),
        _entry(order, 34853, 4, 1, 68),
    )
    gps = _directory(
        order,
        _entry(order, 1, 2, 2, F.when(i % 2 == 0, synth.raw(b"N\0\0\0")).otherwise(synth.raw(b"S\0\0\0"))),
        _entry(order, 2, 5, 3, 122),
        _entry(order, 3, 2, 2, F.when(i % 3 == 0, synth.raw(b"W\0\0\0")).otherwise(synth.raw(b"E\0\0\0"))),
        _entry(order, 4, 5, 3, 146),
    )
    sub = _directory(order, _entry(order, 513, 4, 1, 200), _entry(order, 514, 4, 1, u32(F.octet_length(thumb))))
    places = F.concat(degrees(i % 90, i % 60, i % 6000), degrees(i % 180, i * 7 % 60, i * 13 % 6000))
    return F.concat(_head(order), main, synth.raw(b"Canon\0"), gps, places, sub, thumb, _artist(), synth.raw(b"\0"))


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "raw", _either(_camera("<"), _camera(">")))


def raw_camera_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera files of both byte orders: the artist, the position and the thumbnail's segments go."""
    return _report(_cameras(spark, sf_dir))


def raw_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees from the GPS directories of the same files."""
    found = inspect.fields(_cameras(spark, sf_dir), "doc_id").filter("section = 'gps'")
    at = lambda name: F.round(F.col("detail")[name].cast("double"), 9).alias(name)
    return found.select("doc_id", "place", at("latitude"), at("longitude"))


_POSITION_SQL = """SELECT doc_id, 'GPS' AS place,
    round((CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) * ((doc_id % 90)::double + (doc_id % 60)::double / 60 + (doc_id % 6000)::double / 100 / 3600), 9) AS latitude,
    round((CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END) * ((doc_id % 180)::double + (doc_id * 7 % 60)::double / 60 + (doc_id * 13 % 6000)::double / 100 / 3600), 9) AS longitude
    FROM documents"""


def _overlapping(order: str, late: bool) -> Column:
    """The artist's value runs over the sub-directory, which is read after it was cleared (late), or before."""
    sub = _directory(order, _entry(order, 306, 2, 4, synth.raw(b"2024")))
    artist = _entry(order, 315, 2, F.octet_length(_artist()) + 18, 38)
    pointer = _entry(order, 330, 4, 1, _number(F.octet_length(_artist()) + 38, 4, order))
    return F.concat(_head(order), _directory(order, *((artist, pointer) if late else (pointer, artist))), _artist(), sub)


def raw_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory that a value covers is empty once the value is cleared, and whole before."""
    return _report(_made(spark, sf_dir, "raw", _either(_overlapping("<", True), _overlapping(">", False))))


def cr3_uuid_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uuid boxes with a TIFF, XMP, a JPEG, a TIFF that breaks off, which is left as it was, and something else."""
    data = synth.bytes_of(F.col("text"))
    uuids = (synth.tiff(F.col("text")), F.concat(synth.raw(b"<?xpacket"), data), synth.jpeg(F.col("text"), _scan()), F.concat(synth.raw(b"II*\0\xff\xff\xff\xff"), data), F.concat(synth.raw(b"plain"), data))
    moov = synth.box(b"moov", synth.box(b"mvhd", synth.raw(synth.MVHD)), *(synth.box(b"uuid", x) for x in uuids))
    return _report(_made(spark, sf_dir, "cr3", F.concat(synth.box(b"ftyp", synth.raw(b"crx \0\0\0\1")), moov, synth.box(b"mdat", _scan()))))


def _shared_items(exif_first: bool) -> Column:
    """An Exif and an XMP item that lie in the same bytes, and an image."""
    exif = F.concat(synth.raw(b"\0\0\0\6Exif\0\0"), synth.tiff(F.col("text")))
    xmp_entry, exif_entry = synth.box(b"infe", synth.raw(b"\2\0\0\0\0\1\0\0mime\0application/rdf+xml\0")), synth.box(b"infe", synth.raw(b"\2\0\0\0\0\2\0\0Exif\0"))
    order = (exif_entry, xmp_entry) if exif_first else (xmp_entry, exif_entry)
    iinf = synth.box(b"iinf", synth.raw(b"\0\0\0\0\0\3"), *order, synth.box(b"infe", synth.raw(b"\2\0\0\0\0\3\0\0hvc1\0")))
    ftyp = synth.box(b"ftyp", synth.raw(b"heic\0\0\0\0"))
    # the boxes before the data have one size: 16 of ftyp, 181 of meta and 8 of mdat's head
    at, n = F.lit(16 + 181 + 8), F.octet_length(exif)
    place = lambda number, start, size: F.concat(synth.raw(bytes([0, number, 0, 0, 0, 1])), synth.be32(start), synth.be32(size))
    iloc = synth.box(b"iloc", synth.raw(b"\0\0\0\0\x44\0\0\3"), place(1, at, n), place(2, at, n), place(3, at + n, F.octet_length(_scan())))
    return F.concat(ftyp, synth.box(b"meta", synth.raw(bytes(4)), synth.box(b"pitm", synth.raw(b"\0\0\0\0\0\3")), iinf, iloc), synth.box(b"mdat", exif, _scan()))


def heic_shared_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first of two items in the same bytes cleared, the second no longer finds."""
    return _report(_made(spark, sf_dir, "heic", _either(_shared_items(False), _shared_items(True))))


_CR3_KEPT = "format('moov({}), mvhd(32), IFD0(30), uuid({}), uuid({})', 170 + g + 4 * n + 10 * s + m, 16 + n, 13 + n)"
_SHARED_KEPT = "CASE WHEN doc_id % 2 = 0 THEN format('meta(181), ITEM-hvc1({})', m) ELSE format('meta(181), IFD0(30), ITEM-hvc1({})', m) END"
_SHARED_DROPPED = "CASE WHEN doc_id % 2 = 0 THEN format('XMP({}), Exif({})', 55 + g, 55 + g) ELSE format('Artist({}), XMP({})', g + 1, 55 + g) END"
_OVERLAP_DROPPED = "CASE WHEN doc_id % 2 = 0 THEN format('Artist({})', g + 18) ELSE format('DateTime(4), Artist({})', g + 18) END"

QUERIES: dict[str, Query] = {
    "raw_camera_report": raw_camera_report,
    "raw_position": raw_position,
    "raw_overlap_report": raw_overlap_report,
    "cr3_uuid_report": cr3_uuid_report,
    "heic_shared_report": heic_shared_report,
}
ORACLE_SQL: dict[str, str] = {
    "raw_camera_report": _report_sql("'IFD0(54), SubIFD(30), GPS(54)'", "format('Artist({}), GPS(52), THMB({})', g + 1, n + 6 * s)"),
    "raw_position": _POSITION_SQL,
    "raw_overlap_report": _report_sql("CASE WHEN doc_id % 2 = 0 THEN 'IFD0(30), SubIFD(6)' ELSE 'IFD0(30), SubIFD(18)' END", _OVERLAP_DROPPED),
    "cr3_uuid_report": _report_sql(_CR3_KEPT, "format('Artist({}), uuid-XMP({}), uuid-JPEG({})', g + 1, 17 + n, n + 6 * s)"),
    "heic_shared_report": _report_sql(_SHARED_KEPT, _SHARED_DROPPED),
}
