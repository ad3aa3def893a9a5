"""Embedded metadata of media files as a table of fields, its text made safe and scrubbed, and as one VARIANT per file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

from sieveworks.operators import textclean
from sieveworks.operators.strip import MUSICAL, READERS, with_error
from sieveworks.operators.variants import quoted
from sieveworks.sources.fields import FIELD_READERS, FIELDS, rows
from sieveworks.sources.shared import saved
from sieveworks.sources.units import Malformed

#: Bytes of a value that are shown; of a preview.
LONGEST, PREVIEW = 4000, 300
_UNPRINTABLE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


@pandas_udf(FIELDS)
def scan_fields(format: pd.Series, content: pd.Series) -> pd.Series:
    """The metadata fields of each file; what breaks off early gives the fields up to there."""
    out = []
    for kind, data in zip(format, content, strict=True):
        found: list | None = None
        if data is not None and kind in FIELD_READERS:
            found = []
            try:
                for field in rows(FIELD_READERS[kind](bytes(data))):
                    found.append(field)
            except (Malformed, RecursionError):
                pass
        out.append(found)
    return pd.Series(out)


#: What a field needs to be shown: raw and name up to LONGEST bytes, and of the whole of raw its bytes, those without NULs and spaces at the end, and those that are no controls.
SHOWN = T.ArrayType(T.StructType([*FIELDS.elementType.fields, *(T.StructField(c, T.LongType()) for c in ("length", "trimmed", "textual"))]))
PARSED = T.StructType().add("units", T.ArrayType(T.StructType().add("role", "string").add("size", "long"))).add("error", "string").add("fields", SHOWN)
_PARSED_ARROW = to_arrow_type(PARSED)
#: Parts, fields or nodes that a worker holds as Python objects at once, many times as large there as in Arrow; a file's own, if they are more.
PIECE = 4000
_CONTROLS = bytes(k for k in range(128) if k < 32 and k not in b"\t\n\r" or k == 127)


def _shown(field: dict) -> dict:
    """A field with the counts of its raw bytes, which are cut, but for segments: their kind may show anywhere in them."""
    raw = field["raw"]
    if raw is None:
        return field | {"length": None, "trimmed": None, "textual": None}
    counts = {"length": len(raw), "trimmed": len(raw.rstrip(b"\0 ")), "textual": len(raw.translate(None, _CONTROLS))}
    return field | counts | {"name": field["name"][:LONGEST], "raw": raw if field["section"] == "segments" else raw[:LONGEST]}


@arrow_udf(PARSED)
def scan_parsed(format: pa.Array, content: pa.Array) -> pa.Array:
    """scan_units() and scan_fields() of each file in one pass: its parts, why it has none, and its fields as they are shown."""
    out, done, held = [], [], 0
    for kind, data in zip(format.to_pylist(), content, strict=True):
        units, error, found = None, None, None
        if data.is_valid and kind in READERS:
            data = data.as_py()
            try:
                units = [{"role": u.role, "size": u.size} for u in READERS[kind](data)]
            except (Malformed, RecursionError) as why:
                error = str(why)
            if error is None and kind in FIELD_READERS:
                found = []
                try:
                    for field in rows(FIELD_READERS[kind](data)):
                        found.append(_shown(field))
                except (Malformed, RecursionError):
                    pass
        out.append({"units": units, "error": error, "fields": found})
        held += 1 + len(units or ()) + len(found or ())
        if held >= PIECE:
            done.append(pa.array(out, _PARSED_ARROW))
            out, held = [], 0
    return pa.concat_arrays([*done, pa.array(out, _PARSED_ARROW)])


def sanitise(raw: Column, longest: int = LONGEST) -> Column:
    """The first bytes as text: controls become ``?``, and if the bytes aren't UTF-8, all beyond ASCII too."""
    head = F.substring(raw, 1, longest)
    ascii_only = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\t\n\r\x20-\x7E]", "?")
    return F.when(F.is_valid_utf8(head.cast("string")), F.regexp_replace(head.cast("string"), _UNPRINTABLE, "?")).otherwise(ascii_only)


def clean_tag(raw: Column, trimmed: Column) -> Column:
    """sanitise() of the trimmed bytes, those before the NULs and spaces at the end."""
    return sanitise(F.substr(raw, F.lit(1), trimmed.cast("int")))


def text_or_null(raw: Column, length: Column, textual: Column, longest: int = PREVIEW) -> Column:
    """sanitise() where 70 % of the length may be text, textual bytes of it, else null, as for nothing."""
    return F.when((length > 0) & (textual * 10 >= length * 7), sanitise(raw, longest))


def jpeg_kind(marker: Column, raw: Column) -> Column:
    """What a JPEG metadata segment holds, by its first bytes."""
    head = F.decode(raw, "ISO-8859-1")
    return (
        F.when(marker == "COM", "comment")
        .when(head.startswith("Exif\0\0"), "exif")
        .when(head.contains("http://ns.adobe.com/xap/1.0/") | head.startswith("XMP"), "xmp")
        .when(head.startswith("ICC_PROFILE"), "icc")
        .when(head.startswith("Photoshop 3.0") | head.startswith("8BIM"), "photoshop")
        .when(head.startswith("JFIF\0"), "jfif")
        .when(head.startswith("Adobe"), "adobe")
        .otherwise("unknown")
    )


def _ratio(text: Column) -> Column:
    """ "n/d" as a double; null where d is 0."""
    return F.try_divide(F.split_part(text, F.lit("/"), F.lit(1)).cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).cast("double"))


def degrees(rationals: Column, ref: Column, negative: str) -> Column:
    """Degrees, minutes and seconds as one signed double."""
    part = lambda k: _ratio(F.split_part(rationals, F.lit(" "), F.lit(k)))
    value = part(1) + part(2) / 60 + part(3) / 3600
    return F.when(ref == negative, -value).otherwise(value)


def ebml_date(ns: Column) -> Column:
    """Nanoseconds since 2001, a long or a decimal of no places, as a UTC date in any session's time zone, seconds cut towards zero."""
    seconds, day = F.call_function("div", ns, F.lit(1_000_000_000)), F.lit(86_400)
    at = F.lit("2001-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.call_function("div", seconds, day).cast("int"), secs=seconds % day)
    shown = F.regexp_replace(at.cast("string"), r"^\+|(?<=^-)0+", "")  # years of five digits, which a long doesn't reach, have no sign
    return F.concat(F.translate(shown, " ", "T"), F.lit("Z"))


def _added(section: Column, detail: Column) -> Column:
    """detail with what SQL derives: a position in degrees, a date."""
    d = lambda k: F.try_element_at(detail, F.lit(k))
    below = F.coalesce(d("altRef") == "1", F.lit(False))
    altitude = F.when(below, -_ratio(d("alt"))).otherwise(_ratio(d("alt")))
    position = F.map_filter(
        F.create_map(
            F.lit("latitude"), degrees(d("lat"), d("latRef"), "S").cast("string"),
            F.lit("longitude"), degrees(d("lon"), d("lonRef"), "W").cast("string"),
            F.lit("altitude"), altitude.cast("string"),
        ),
        lambda _, v: v.isNotNull(),
    )
    date = F.create_map(F.lit("ns"), d("ns"), F.lit("iso"), ebml_date(d("ns").cast("long")))
    return F.when(section == "gps", position).when(d("ns").isNotNull(), date).otherwise(detail)


def _parsed(files: DataFrame, key: str, keep_musical: bool) -> DataFrame:
    """fields() with level, parent and opened (no value of its own), and before them a row -1 for each file itself."""
    root = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in SHOWN.elementType.fields))
    listed = F.concat(F.array(root), F.when(F.col("error").isNull(), F.col("fields")))
    checked = with_error(files, scan_parsed, "fields").select(key, "format", listed.alias("fields"))
    # outer: else Spark filters empty arrays away before, and for that every file is parsed twice
    parsed = checked.select(F.col(key), "format", F.posexplode_outer("fields").alias("seq", "f")).filter("seq is not null")
    parsed = parsed.select(key, "format", (F.col("seq") - 1).alias("seq"), "f.section", F.col("f.path").alias("place"), "f.name", "f.raw", "f.size", "f.detail", "f.level", "f.parent", "f.length", "f.trimmed", "f.textual")
    if keep_musical:
        musical = (F.col("format") == "wav") & (F.col("section") == "chunks") & F.trim(F.col("name").cast("string")).isin(*(role.strip() for _, role, _, _ in MUSICAL))
        parsed = parsed.filter(~F.coalesce(musical, F.lit(False)))
    previewed = F.col("section").isin("segments", "boxes") | ((F.col("section") == "chunks") & (F.col("format") == "webp"))
    whole = F.col("format").isin("png", "gif")
    raw = F.col("raw")
    value = F.when(previewed, text_or_null(raw, F.col("length"), F.col("textual"))).when(whole, sanitise(raw)).otherwise(clean_tag(raw, F.col("trimmed")))
    kind = F.when(F.col("section") == "segments", jpeg_kind(F.col("name").cast("string"), F.col("raw")))
    boxes = F.col("section") == "boxes"
    label = F.when(boxes, F.regexp_replace(F.decode("name", "ISO-8859-1"), r"[^\x20-\x7E]", "?")).otherwise(sanitise(F.col("name")))
    place = F.when(boxes, F.regexp_replace("place", r"[^\x20-\x7E]", "?")).otherwise(F.col("place"))
    # the keys of info and of a directory's tags stay as they are, all else is scrubbed
    keys = (F.col("section") == "info") | ((F.col("section") == "tags") & (F.col("format") != "mkv"))
    detail = _added(F.col("section"), F.col("detail"))
    parsed = parsed.select(key, "format", "seq", "section", kind.alias("kind"), "size", "level", "parent", F.col("raw").isNull().alias("opened"), F.when(keys, label).alias("label"), F.map_keys(detail).alias("keys"), F.concat(F.array(value, F.when(~keys, label), place), F.map_values(detail)).alias("strings"))
    # files are read once; then only rows with something to clean are shuffled
    parsed = saved(parsed.withColumn("dirty", F.coalesce(F.exists("strings", lambda x: textclean.touched(x, textclean.SCRUB)), F.lit(False))), "metadata-fields")
    plain, dirty = parsed.filter("not dirty").drop("dirty"), parsed.filter("dirty").drop("dirty")
    clean = plain.unionByName(textclean.clean_strings(dirty, (key, "seq"), "strings", textclean.SCRUB))
    at = lambda k: F.get("strings", F.lit(k))
    rest = F.map_from_arrays("keys", F.slice("strings", 4, F.greatest(F.size("strings") - 3, F.lit(0))))
    return clean.select(key, "format", "seq", "section", at(2).alias("place"), F.coalesce("label", at(1)).alias("name"), "kind", at(0).alias("value"), "size", rest.alias("detail"), "level", "parent", "opened")


def fields(files: DataFrame, key: str, keep_musical: bool = False) -> DataFrame:
    """(key, format, seq, section, place, name, kind, value, size, detail) of the files' metadata; key identifies a file.

    place is the path of boxes, directories or tags inside the file. key must not be named as one of the others.

    With keep_musical the WAV chunks that cleaning then keeps aren't listed. A file that cleaning refuses has no fields.
    Values, names, places and details lose invisible code points as cleaning drops them (the ids of info chunks and
    the names of directory tags, which are keys, don't). For that the fields are parsed once, when this is called, and
    saved; those with something to clean, not the files, are shuffled once.
    """
    return _parsed(files, key, keep_musical).filter("seq >= 0").drop("level", "parent", "opened")


def metadata(files: DataFrame, key: str, keep_musical: bool = False) -> DataFrame:
    """(key, format, metadata) with one VARIANT per file that has fields: its sections, each a list of fields in order."""
    found = fields(files, key, keep_musical)
    shown = ("place", "name", "kind", "value", "size", "detail")
    one = F.struct("seq", F.to_json(F.struct(*shown)).alias("json"))
    sections = found.groupBy(key, "format", "section").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    listed = F.concat(F.to_json(F.array("section")).substr(F.lit(2), F.length(F.to_json(F.array("section"))) - 2), F.lit(":["), F.array_join("rows.json", ","), F.lit("]"))
    whole = sections.groupBy(key, "format").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(listed)), ","), F.lit("}")).alias("m"))
    return whole.select(key, "format", F.parse_json("m").alias("metadata"))


#: What a file's tree, a directory's and a camera uuid box's hold when nothing was found for it.
_EMPTY = {
    "wav": {"info": "{}", "chunks": "[]"},
    "avi": {"info": "{}", "chunks": "[]"},
    "jpeg": {"segments": "[]"},
    "png": {"text": "[]", "compressedText": "[]", "translatedText": "[]", "profiles": "[]", "exif": "[]", "time": "null", "chunks": "[]"},
    "gif": {"comments": "[]", "texts": "[]", "apps": "[]"},
    "webp": {"chunks": "[]"},
    "mp4": {"timestamps": "[]", "boxes": "[]"},
    "mkv": {"info": "{}", "tags": "[]", "attachments": "[]"},
    "raw": {"byteOrder": "null", "ifds": "[]"},
    "cr3": {"timestamps": "[]", "boxes": "[]"},
    "heic": {"items": "[]", "exif": "null", "timestamps": "[]"},
}
_DIRECTORY = {"tags": "{}", "gps": "null", "makerNote": "null", "xmp": "null"}
#: How a child stands in its parent: as an item of a list, a member of an object under its own name, or a value.
LIST, MEMBER, VALUE = "list", "member", "value"


def _number(text: Column) -> Column:
    """Digits as a JSON number where a long holds them, else as a string."""
    return F.coalesce(text.try_cast("long").cast("string"), quoted(text))


def _object(**members: Column) -> Column:
    """A JSON object of members that are JSON already; null ones are null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _own() -> tuple[Column, Column, Column]:
    """(slot, mode, json) of a field in its parent; json lacks the children's part."""
    section, format, detail = F.col("section"), F.col("format"), lambda k: F.try_element_at("detail", F.lit(k))
    name, value, size = quoted(F.col("name")), quoted(F.col("value")), F.col("size").cast("string")
    camera = format.isin("raw", "cr3", "heic")
    date = _object(ns=_number(detail("ns")), iso=quoted(detail("iso")))
    gps = F.concat(F.lit("{"), F.concat_ws(",", F.transform(F.map_entries("detail"), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))), F.lit("}"))
    path = F.concat_ws("/", F.when(F.col("place") != "", F.col("place")), "name")
    times = _object(box=name, version=detail("version"), creation=_number(detail("creation")))
    rules = (
        (section == "info", section, MEMBER, F.when(F.col("name") == "dateUtc", F.when(detail("ns").isNotNull(), date)).otherwise(value)),
        ((section == "chunks") & (format == "png"), section, LIST, _object(type=name, size=size)),
        ((section == "chunks") & (format == "webp"), section, LIST, _object(type=name, size=size, preview=value)),
        (section == "chunks", section, LIST, _object(id=name, size=size)),
        (section == "segments", section, LIST, _object(marker=name, size=size, kind=quoted(F.col("kind")), preview=value)),
        (section == "text", section, LIST, _object(keyword=name, text=value)),
        (section == "compressedText", section, LIST, _object(keyword=name, method=detail("method"), size=size)),
        (section == "translatedText", section, LIST, _object(keyword=name, compressed=detail("compressed"), lang=quoted(detail("lang")), text=value)),
        (section == "profiles", section, LIST, _object(profile=name, method=detail("method"), size=size)),
        ((section == "exif"), section, LIST, _object(size=size)),
        (section == "time", section, VALUE, value),
        (section.isin("comments", "texts"), section, LIST, value),
        (section == "apps", section, LIST, _object(id=name, size=size)),
        ((section == "timestamps") & (format == "heic"), section, LIST, times),
        (section == "timestamps", section, LIST, _object(box=name, version=detail("version"), creation=_number(detail("creation")), modification=_number(detail("modification")))),
        ((section == "boxes") & (format == "cr3") & (F.col("name") == "uuid"), section, LIST, _object(type=name, kind=quoted(detail("kind")), size=size)),
        ((section == "boxes") & ((format == "cr3") | F.col("opened")), F.when(F.col("level") > 0, "children").otherwise("boxes"), LIST, _object(type=name, size=size)),
        (section == "boxes", F.when(F.col("level") > 0, "children").otherwise("boxes"), LIST, _object(type=name, size=size, text=value)),
        ((section == "tags") & camera, section, MEMBER, value),
        (section == "tags", section, LIST, _object(tag=quoted(path), value=value)),
        (section == "attachments", section, LIST, _object(file=quoted(detail("file")), mime=quoted(detail("mime")), size=size, description=quoted(detail("description")))),
        ((section == "tiff") & (format == "raw"), F.lit("byteOrder"), VALUE, value),
        (section == "tiff", F.when(format == "cr3", "tiff").otherwise("exif"), VALUE, _object(byteOrder=value)),
        (section == "ifds", F.when(F.element_at(F.split("place", "/"), -1) == "IFD0", "ifds").otherwise("subIfds"), LIST, _object(id=quoted(F.element_at(F.split("place", "/"), -1)))),
        (section == "blobs", F.when(F.col("name") == "XMP", "xmp").otherwise("makerNote"), VALUE, size),
        (section == "gps", section, VALUE, F.when(F.size("detail") > 0, gps)),
        (section == "items", section, LIST, _object(id=_number(detail("id")), type=F.when(detail("type") == "", '"unknown"').otherwise(quoted(detail("type"))), name=name, contentType=value, size=size)),
    )
    slot, mode, json = F, F, F
    for when, to, how, text in rules:
        slot, mode, json = slot.when(when, to), mode.when(when, F.lit(how)), json.when(when, F.coalesce(text, F.lit("null")))
    return slot, mode, json.otherwise(F.lit("{}"))


def _shape() -> Column:
    """Which slots a row's JSON has even without children: a file's, by its format, a directory's or a camera box's."""
    camera = (F.col("section") == "boxes") & (F.col("format") == "cr3") & (F.try_element_at("detail", F.lit("kind")) == "tiff")
    return F.when(F.col("seq") < 0, F.col("format")).when(F.col("section") == "ifds", "ifds").when(camera, "camera")


_SLOTS = _EMPTY | {"ifds": _DIRECTORY, "camera": {"tiff": "null"}, None: {}}


def _closed(json: str, slots: dict[str, tuple[str, list | dict | str]], shape: str | None) -> str:
    """A node's JSON with what its children put into its slots, and the defaults of those that nothing fills."""
    members = [] if json == "{}" else [json[1:-1]]
    for slot, (mode, found) in slots.items():
        if mode == LIST:
            found = f"[{','.join(reversed(found))}]"
        elif mode == MEMBER:
            found = f"{{{','.join(f'{k}:{v}' for k, v in found.items())}}}"
        members.append(f'"{slot}":{found}')
    return f"{{{','.join(members + [f'"{k}":{v}' for k, v in _SLOTS[shape].items() if k not in slots])}}}" if slots or _SLOTS[shape] else json


@arrow_udf(T.StringType())
def fold(nodes: pa.Array) -> pa.Array:
    """The JSON of each file from its nodes (seq, parent, slot, mode, label, json, shape): the last is closed and put into its parent first, so children come before their parents."""
    out, lengths, first, held = [], nodes.value_lengths().to_pylist(), 0, 0
    for k, n in enumerate(lengths, 1):
        held += n
        if held >= PIECE or k == len(lengths):
            out.append(pa.array(_folded(nodes.slice(first, k - first), lengths[first:k]), pa.string()))
            first, held = k, 0
    return pa.concat_arrays(out or [pa.array([], pa.string())])


def _folded(nodes: pa.Array, lengths: list[int]) -> Iterator[str]:
    """The JSON of each file, whose nodes are so many of all."""
    columns, at = [c.to_pylist() for c in nodes.flatten().flatten()], 0
    for n in lengths:
        slots: dict[int, dict] = {}
        for seq, parent, slot, mode, label, json, shape in sorted(zip(*(c[at : at + n] for c in columns), strict=True), reverse=True, key=lambda x: x[0]):
            json = _closed(json, slots.pop(seq, {}), shape)
            if seq < 0:
                yield json
                break
            found = slots.setdefault(parent, {})
            if mode == LIST:
                found.setdefault(slot, (mode, []))[1].append(json)
            elif mode == MEMBER:
                found.setdefault(slot, (mode, {}))[1].setdefault(label, json)
            else:
                found.setdefault(slot, (mode, json))
        at += n


def trees(files: DataFrame, key: str, keep_musical: bool = False) -> DataFrame:
    """(key, format, metadata): one VARIANT for each file that cleaning accepts, in the shape of its format's own tree.

    Boxes hold ``children``, directories ``tags``, ``gps``, ``makerNote``, ``xmp`` and ``subIfds``, camera boxes and image items
    a ``tiff`` or ``exif`` of their own; every section is there, empty where a file has nothing for it. Strings are
    scrubbed as in fields(); key identifies a file. Of members of one name the last counts.

    The fields are parsed once and saved. Each one's own JSON is SQL; one shuffle by key brings a file's together, which
    were one row of the parser's too, and they are folded bottom-up in one pass however deep they lie.
    """
    slot, mode, json = _own()
    nodes = _parsed(files, key, keep_musical).withColumns({"slot": slot, "mode": mode, "json": json, "shape": _shape()})
    label = F.when(F.col("mode") == MEMBER, quoted(F.col("name")))
    whole = nodes.groupBy(key, "format").agg(F.collect_list(F.struct("seq", "parent", "slot", "mode", label.alias("label"), "json", "shape")).alias("nodes"))
    return whole.select(key, "format", F.parse_json(fold("nodes")).alias("metadata"))
