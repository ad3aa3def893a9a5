"""Removal of metadata from media files: scan, policy, structural checks, edits and report, one row per file.

Only the scan of a container's parts and the splicing of bytes run in Python, in Arrow batches; what is kept, dropped
and how bytes are changed is decided by column expressions over the array of parts. Nothing is shuffled, and the
scan isn't read by what needs only the report: column pruning drops the splice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sieveworks.sources import flat, tree
from sieveworks.sources.formats import magic_error
from sieveworks.sources.units import SCANNED, Malformed, Unit

READERS: dict[str, Callable[[bytes], Iterator[Unit]]] = {
    "wav": flat.wav,
    "webp": flat.webp,
    "avi": flat.avi,
    "jpeg": flat.jpeg,
    "png": flat.png,
    "gif": flat.gif,
    "mp4": tree.mp4,
    "mkv": tree.mkv,
    "raw": tree.tiff,
    "cr3": tree.cr3,
    "heic": tree.heic,
}

# What happens to the parts of each format, by role; "*" stands for all others. Parts without an action
# are in no report.
KEEP, DROP = "keep", "drop"
#: Ways to change bytes: cut the part out, overwrite its zones with zeros, or turn it into the format's filler.
CUT, ZERO, JUNK, FREE, VOID = "cut", "zero", "junk", "free", "void"
_ISO = (("udta", DROP, FREE), *((x, KEEP, ZERO) for x in sorted(tree.TIMED)), *((x, KEEP, None) for x in sorted(tree.CONTAINERS)))
_TIFF = (
    ("ifd", KEEP, None),
    ("gps", DROP, ZERO),
    ("thumb", DROP, ZERO),
    *((f"tag{x}", DROP, ZERO) for x in sorted(tree.PRIVATE_TAGS)),
)
_UUID = (("uuid-XMP", DROP, ZERO), ("uuid-JPEG", DROP, ZERO), ("uuid-other", KEEP, None))
POLICY: dict[str, tuple[tuple[str, str | None, str | None], ...]] = {
    "wav": (*((x, KEEP, None) for x in ("fmt ", "fact", "data")), ("info", None, None), ("tail", None, CUT), ("*", DROP, CUT)),
    "webp": (*((x, DROP, CUT) for x in ("EXIF", "XMP ", "ICCP")), ("tail", None, CUT), ("*", KEEP, None)),
    "avi": (*((x, DROP, JUNK) for x in ("LIST-INFO", "id3 ", "DISP")), ("info", None, None), ("*", KEEP, None)),
    "jpeg": (*((f"APP{k}", DROP, CUT) for k in range(16)), ("COM", DROP, CUT), ("fill", None, CUT), ("*", KEEP, None)),
    "png": (*((x, KEEP, None) for x in "IHDR PLTE IDAT IEND tRNS sRGB gAMA cHRM sBIT bKGD hIST pHYs sPLT acTL fcTL fdAT".split()), ("*", DROP, CUT)),
    "gif": (*((x, DROP, CUT) for x in ("COMMENT", "TEXT", "APP")), ("*", KEEP, None)),
    "mp4": (*_ISO, ("meta", DROP, FREE), ("uuid", DROP, FREE)),
    "mkv": (*((x, DROP, VOID) for x in ("Tags", "Attachments", *sorted(f"Info/{n}" for n in tree.PERSONAL_INFO), "Info/CRC-32 stale")), ("Info/CRC-32", None, None), ("*", KEEP, None)),
    "raw": _TIFF,
    "cr3": (*_ISO, *_TIFF, *_UUID, ("prvw", KEEP, None), ("PRVW", DROP, ZERO)),
    "heic": (*_ISO, *_TIFF, *_UUID, ("uuid", DROP, FREE), ("meta", KEEP, None), ("item", KEEP, None), ("item-exif", DROP, ZERO), ("item-xmp", DROP, ZERO)),
}
MUSICAL = tuple(("wav", x, KEEP, None) for x in ("cue ", "smpl", "inst", "acid"))
#: Formats that are rebuilt from the parts kept; the others keep their size.
REBUILT = ("wav", "webp", "jpeg", "png", "gif")


def policy_rows(keep_musical: bool = False) -> list[tuple[str, str, str | None, str | None]]:
    rows = {(f, role): (action, how) for f, rules in POLICY.items() for role, action, how in rules}
    rows |= {(f, role): (action, how) for f, role, action, how in MUSICAL} if keep_musical else {}
    return [(*k, *v) for k, v in rows.items()]


def policy_table(spark: SparkSession, keep_musical: bool = False) -> DataFrame:
    """(format, role, action, how): the policies as a table of some 150 rows, for joins with exploded parts."""
    return spark.createDataFrame(policy_rows(keep_musical), "format string, role string, action string, how string")


@pandas_udf(SCANNED)
def scan_units(format: pd.Series, content: pd.Series) -> pd.DataFrame:
    """The parts of each file by its format's reader; null content or an unknown format: null parts, no error."""
    rows = []
    for kind, data in zip(format, content, strict=True):
        try:
            rows.append((None if data is None or kind not in READERS else [u._replace(zones=[{"at": a, "len": n} for a, n in u.zones])._asdict() for u in READERS[kind](bytes(data))], None))
        except (Malformed, RecursionError) as why:
            rows.append((None, str(why)))
    return pd.DataFrame(rows, columns=["units", "error"])


@pandas_udf(T.BinaryType())
def splice(content: pd.Series, edits: pd.Series) -> pd.Series:
    """Content after its edits: put (null: zeros) replaces len bytes at at. Overwriting happens in order, the rest at once."""
    out = []
    for data, changes in zip(content, edits, strict=True):
        if data is None or changes is None:
            out.append(None)
            continue
        buffer, moves = bytearray(data), []
        for e in changes:
            put = bytes(e["len"]) if e["put"] is None else bytes(e["put"])
            if len(put) == e["len"]:
                buffer[e["at"] : e["at"] + e["len"]] = put
            else:
                moves.append((e["at"], e["len"], put))
        parts, at = [], 0
        for start, n, put in sorted(moves):
            parts += [buffer[at:start], put]
            at = start + n
        out.append(bytes(b"".join([*parts, buffer[at:]]) if moves else buffer))
    return pd.Series(out)


def le32(n: Column) -> Column:
    """A number as four bytes, the lowest first."""
    return F.unhex(F.regexp_replace(F.lpad(F.hex(n), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))


def _edit(at: Column, n: Column, put: Column | None = None) -> Column:
    return F.struct(at.cast("long").alias("at"), n.cast("long").alias("len"), (F.lit(None).cast("binary") if put is None else put).alias("put"))


def _void_header(total: Column) -> Column:
    """A Void element's id and size for total bytes in all, with as short a size field as can be."""
    out = F
    for n in range(1, 9):
        payload = total - 1 - n
        coded = F.lpad(F.hex(payload + F.lit(1 << 7 * n)), 2 * n, "0")
        out = out.when(payload <= (1 << 7 * n) - 2, F.unhex(F.concat(F.lit("EC"), coded)))
    return out


def _edits_of(u: Column) -> Column:
    """The edits of one decided part, as an array."""
    total, head = u["stop"] - u["start"], _void_header(u["stop"] - u["start"])
    zeros = F.transform(u["zones"], lambda z: _edit(z["at"], z["len"]))
    return (
        F.when(u["how"] == CUT, F.array(_edit(u["start"], total, F.unhex(F.lit("")))))
        .when(u["how"] == ZERO, zeros)
        .when(u["how"] == FREE, F.concat(F.array(_edit(u["start"] + 4, F.lit(4), F.lit(b"free"))), zeros))
        .when(u["how"] == JUNK, F.array(_edit(u["start"], F.lit(8), F.concat(F.lit(b"JUNK"), le32(total - 8))), _edit(u["start"] + 8, total - 8)))
        .when(u["how"] == VOID, F.array(_edit(u["start"], F.octet_length(head), head), _edit(u["start"] + F.octet_length(head), total - F.octet_length(head))))
        .otherwise(F.array().cast("array<struct<at:bigint,len:bigint,put:binary>>"))
    )


def _riff_edits(units: Column) -> Column:
    """A rebuilt RIFF file: every kept odd part gets a zero pad byte, and the header the new size."""
    kept = F.filter(units, lambda u: u["action"] == KEEP)
    body = F.aggregate(kept, F.lit(4).cast("long"), lambda n, u: n + 8 + u["size"] + u["size"] % 2)
    odd = F.filter(kept, lambda u: u["size"] % 2 == 1)
    pads = F.transform(odd, lambda u: _edit(u["body"] + u["size"], u["stop"] - u["body"] - u["size"], F.lit(b"\0")))
    return F.concat(F.array(_edit(F.lit(4), F.lit(4), le32(body))), pads)


def _has(units: Column, *roles: str) -> Column:
    return F.exists(units, lambda u: u["role"].isin(*roles))


def structure_error(format: Column, units: Column) -> Column:
    """What the parts lack, or have too much of; null: nothing."""
    first, last, only = F.get(units, F.lit(0)), F.element_at(units, -1), lambda r: F.size(F.filter(units, lambda u: u["role"] == r)) == 1
    need = (
        ("wav", _has(units, "fmt "), "WAV has no fmt chunk"),
        ("wav", _has(units, "data"), "WAV has no data chunk"),
        ("webp", _has(units, "VP8 ", "VP8L", "VP8X"), "WebP has no image chunk (VP8/VP8L/VP8X)"),
        ("avi", _has(units, "LIST-movi"), "invalid AVI file (missing movi list)"),
        ("png", (F.size(units) > 0) & (first["role"] == "IHDR"), "invalid PNG file (first chunk is not IHDR)"),
        ("png", only("IHDR") & (first["size"] == 13), "invalid PNG file (bad or duplicate IHDR)"),
        ("png", _has(units, "IDAT"), "invalid PNG file (missing IDAT)"),
        ("png", only("IEND") & (last["role"] == "IEND") & (last["size"] == 0), "PNG file doesn't end with one empty IEND"),
        ("mp4", _has(units, "moov"), "invalid MP4/MOV file (missing moov box)"),
        ("cr3", _has(units, "moov"), "invalid CR3 file (missing moov box)"),
        ("heic", _has(units, "meta"), "invalid HEIC file (missing meta box)"),
        ("mkv", _has(units, "EBML"), "not an MKV/WebM file (missing EBML header)"),
        ("mkv", _has(units, "Segment"), "invalid MKV/WebM file (missing Segment)"),
    )
    out = F
    for name, good, why in need:
        out = out.when((format == name) & ~F.coalesce(good, F.lit(False)), F.lit(why))
    return out


def with_error(files: DataFrame, scan: Callable[[Column, Column], Column] = scan_units, *more: str) -> DataFrame:
    """Adds scanned, the parts that the reader found, and error to (format, content) rows of media files.

    Null content is an error, as is a format without a reader. scan gives units and an error as scan_units does, and may
    give more in the same pass, which is added too.
    """
    early = F.when(F.col("content").isNull(), "no content").when(~F.coalesce(F.col("format").isin(*READERS), F.lit(False)), "unsupported format").otherwise(magic_error(F.col("format"), F.col("content")))
    # null content isn't scanned: a file that is refused at sight costs no Python
    out = files.withColumn("_early", early)
    out = out.withColumn("_scan", scan(F.col("format"), F.when(F.col("_early").isNull(), F.col("content"))))
    error = F.coalesce("_early", "_scan.error", structure_error(F.col("format"), F.col("_scan.units")))
    return out.withColumns({"error": error, "scanned": F.col("_scan.units"), **{c: F.col(f"_scan.{c}") for c in more}}).drop("_early", "_scan")


def with_units(files: DataFrame, keep_musical: bool = False) -> DataFrame:
    """Adds units, each with its action and how, and error to (format, content) rows of media files.

    A file with an error has null units.
    """
    return decided(with_error(files), keep_musical)


def decided(found: DataFrame, keep_musical: bool = False) -> DataFrame:
    """Rows of (format, error, scanned) with units in place of scanned: each part with its action and how."""
    rules: dict[str, dict[str, Column]] = {}
    kind = "struct<action:string,how:string>"
    for f, role, action, how in policy_rows(keep_musical):
        rules.setdefault(f, {})[role] = F.struct(F.lit(action).alias("action"), F.lit(how).alias("how")).cast(kind)

    def by(own: dict[str, Column]) -> Column:
        roles = F.create_map(*(x for r, rule in own.items() for x in (F.lit(r), rule)))

        def decide(u: Column) -> Column:
            rule = F.coalesce(F.try_element_at(roles, u["role"]), own.get("*", F.lit(None).cast(kind)))
            return F.struct(*(u[c].alias(c) for c in Unit._fields), rule["action"].alias("action"), rule["how"].alias("how"))

        return F.transform("scanned", decide)

    units = F
    for f in READERS:
        units = units.when(F.col("error").isNull() & (F.col("format") == f), by(rules[f]))
    return found.withColumn("units", units).drop("scanned")


def _report(units: Column, action: str) -> Column:
    return F.transform(F.filter(units, lambda u: u["action"] == action), lambda u: F.struct(u["id"].alias("id"), u["size"].alias("size")))


def with_report(decided: DataFrame) -> DataFrame:
    """Adds kept and dropped, arrays of (id, size)."""
    return decided.withColumns({"kept": _report(F.col("units"), KEEP), "dropped": _report(F.col("units"), DROP)})


def edits(format: Column, units: Column) -> Column:
    """The array of edits that the decided parts of a file call for."""
    own = F.flatten(F.transform(units, _edits_of))
    return F.when(format.isin("wav", "webp"), F.concat(own, _riff_edits(units))).otherwise(own)


def bytes_out(length: Column, changes: Column) -> Column:
    """The result's size, from the input's and the edits alone."""
    grown = F.aggregate(changes, F.lit(0).cast("long"), lambda n, e: n + F.coalesce(F.octet_length(e["put"]).cast("long"), e["len"]) - e["len"])
    return length + grown


def analyze(files: DataFrame, keep_musical: bool = False) -> DataFrame:
    """The files with kept, dropped, bytes_in, bytes_out, bytes_saved and error, and without their bytes.

    The result's bytes aren't built: its size follows from the edits.
    """
    out = with_report(with_units(files, keep_musical))
    size = bytes_out(F.octet_length("content"), edits(F.col("format"), F.col("units")))
    out = out.withColumns({"bytes_in": F.octet_length("content").cast("long"), "bytes_out": size})
    return out.withColumn("bytes_saved", F.col("bytes_in") - F.col("bytes_out")).drop("units", "content")


def strip(files: DataFrame, keep_musical: bool = False) -> DataFrame:
    """The files with content_out (null where error is not), kept, dropped, bytes_in, bytes_out, bytes_saved and error."""
    out = with_report(with_units(files, keep_musical))
    out = out.withColumn("content_out", splice(F.col("content"), edits(F.col("format"), F.col("units"))))
    out = out.withColumns({"bytes_in": F.octet_length("content").cast("long"), "bytes_out": F.octet_length("content_out").cast("long")})
    return out.withColumn("bytes_saved", F.col("bytes_in") - F.col("bytes_out")).drop("units")


def parts_table(files: DataFrame, *keys: str, keep_musical: bool = False) -> DataFrame:
    """The parts of the files without an error as rows: keys, format, seq, id, role, size, start, body, stop, action, how."""
    decided = with_units(files, keep_musical)
    return decided.select(*keys, "format", F.posexplode("units").alias("seq", "u")).select(*keys, "format", "seq", *(f"u.{c}" for c in ("id", "role", "size", "start", "body", "stop", "action", "how")))


def scanned_parts(files: DataFrame, *keys: str) -> DataFrame:
    """parts_table() before any decision, to join with a policy table: keys, format, seq, id, role, size."""
    good = with_error(files).filter("error is null").select(*keys, "format", F.posexplode("scanned").alias("seq", "u"))
    return good.select(*keys, "format", "seq", "u.id", "u.role", "u.size")


def listed(parts: Column) -> Column:
    """``id(size), id(size)``; "none" for no part."""
    names = F.array_join(F.transform(parts, lambda p: F.concat(F.trim(p["id"]), F.lit("("), p["size"].cast("string"), F.lit(")"))), ", ")
    return F.when(F.size(parts) == 0, "none").otherwise(names)


def result_line(verbose: bool) -> Column:
    """What a terminal shows of a report's row: kept and dropped parts and bytes, each on a line, or how much was dropped."""
    long = F.format_string("kept: %s\ndropped: %s\nbytes: %d -> %d (saved %d)", listed(F.col("kept")), listed(F.col("dropped")), "bytes_in", "bytes_out", "bytes_saved")
    short = F.format_string("dropped %d chunk(s), saved %d bytes", F.size("dropped"), "bytes_saved")
    return F.coalesce(F.concat(F.lit("FAIL "), "error"), long if verbose else short)


def summary(report: DataFrame, *keys: str, verbose: bool = True) -> DataFrame:
    """keys with the text that a terminal shows."""
    return report.select(*keys, result_line(verbose).alias("line"))
