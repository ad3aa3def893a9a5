"""Registered queries of media files, which are made from every document's whole text, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import batch, inspect, strip
from sieveworks.sources import files, formats, synth
from sieveworks.sources.shared import saved

Query = Callable[[SparkSession, str], DataFrame]


def _made() -> dict[str, Column]:
    """The media file that each format makes of a document."""
    text, payload = F.col("text"), synth.bytes_of(F.concat_ws("/", "lang", "source"))
    return {
        "wav": synth.wav(text, payload),
        "webp": synth.webp(text, payload),
        "avi": synth.avi(text, payload),
        "png": synth.png(text, payload),
        "jpeg": synth.jpeg(text, payload),
        "gif": synth.gif(F.concat(F.lit("c"), F.coalesce(text, F.lit("")))),
        "mp4": synth.mp4(text, payload),
        "mkv": synth.mkv(text),
        "raw": synth.tiff(text),
        "cr3": synth.cr3(text, payload),
        "heic": synth.heic(text, payload),
    }


#: kept, dropped and bytes_saved of each, as SQL over n and m, the bytes of text and payload.
EXPECTED: dict[str, tuple[str, str, str]] = {
    "wav": ("format('fmt(16), data({})', m)", "format('LIST({})', 12 + n + n % 2)", "20 + n + n % 2"),
    "webp": ("format('VP8({})', m)", "format('XMP({})', n)", "8 + n + n % 2"),
    "avi": ("format('LIST-hdrl(24), avih(12), LIST-movi({})', 12 + m + m % 2)", "format('LIST-INFO({})', 12 + n + n % 2)", "0"),
    "png": ("format('IHDR(13), IDAT({}), IEND(0)', m)", "format('tEXt({})', 6 + n)", "18 + n"),
    "jpeg": (
        "'SOI(0), SOF0(5), SOS(6)'",
        f"array_to_string(list_transform(range(0, greatest(n, 1), {synth.SEGMENT}), lambda k: format('APP1({{}})', 6 + least(n - k, {synth.SEGMENT}))), ', ')",
        f"n + 10 * greatest(1, (n + {synth.SEGMENT - 1}) // {synth.SEGMENT})",
    ),
    "gif": ("'HDR(13), GCE(8), IMG(14), TRL(1)'", "format('COMMENT({})', 4 + n + (n + 255) // 255)", "4 + n + (n + 255) // 255"),
    "mp4": ("format('moov({}), mvhd(32)', 48 + n)", "format('udta({})', 8 + n)", "0"),
    "mkv": ("format('EBML(16), Segment({}), Info({}), Info/TimestampScale(14), Cluster(15)', 68 + 2 * n, 36 + n)", "format('Info/Title({}), Tags({})', 10 + n, 12 + n)", "0"),
    "raw": ("'IFD0(30)'", "format('Artist({})', greatest(n, 4) + 1)", "0"),
    "cr3": ("format('moov({}), mvhd(32)', 48 + n)", "format('udta({})', 8 + n)", "0"),
    "heic": ("format('meta(146), ITEM-hvc1({})', m)", "format('XMP({})', n)", "0"),
}
_SIZES = "(SELECT doc_id, strlen(coalesce(text, ''))::bigint AS n, strlen(concat_ws('/', lang, source))::bigint AS m FROM documents)"


def media_files(spark: SparkSession, sf_dir: str, format: str) -> DataFrame:
    """(doc_id, format, content) with one media file per document."""
    files.bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.lit(format).alias("format"), _made()[format].alias("content"))


def _report(format: str) -> tuple[Query, str]:
    """What is kept and dropped, from the parts alone."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = strip.analyze(media_files(spark, sf_dir, format))
        return out.select("doc_id", "error", strip.listed(F.col("kept")).alias("kept"), strip.listed(F.col("dropped")).alias("dropped"), "bytes_saved")

    kept, dropped, saved = EXPECTED[format]
    return query, f"SELECT doc_id, NULL::varchar AS error, {kept} AS kept, {dropped} AS dropped, ({saved})::bigint AS bytes_saved FROM {_SIZES}"


def _idempotent(format: str) -> tuple[Query, str]:
    """Cleaning twice gives what cleaning once does, and the text is gone."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        once = strip.strip(media_files(spark, sf_dir, format)).select("doc_id", "format", F.col("content_out").alias("content"))
        twice = strip.strip(saved(once, f"{format}-once"))
        return twice.select("doc_id", F.coalesce(F.col("content") == F.col("content_out"), F.lit(False)).alias("same"))

    return query, "SELECT doc_id, true AS same FROM documents"


#: The field of each format that holds the text: section, place, name.
_SHOWN = {
    "wav": ("info", "", "INAM"),
    "avi": ("info", "", "INAM"),
    "png": ("text", "", "Title"),
    "gif": ("comments", "", ""),
    "webp": ("chunks", "", "XMP"),
    "jpeg": ("segments", "", "APP1"),
    "mp4": ("boxes", "udta", "udta"),
    "mkv": ("info", "", "title"),
    "raw": ("tags", "IFD0", "Artist"),
}


_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def _head_sql(text: str, longest: int) -> str:
    """The first bytes of a text as they are shown: controls become ?, and if a character is cut, all beyond ASCII too."""
    marks = text  # a character beyond ASCII as chr(2) and a chr(1) for each byte that follows its first
    for n, chars in ((1, r"[\x{80}-\x{7FF}]"), (2, r"[\x{800}-\x{FFFF}]"), (3, r"[\x{10000}-\x{10FFFF}]")):
        marks = f"regexp_replace({marks}, '{chars}', chr(2) || repeat(chr(1), {n}), 'g')"
    whole = f"regexp_replace(substr({text}, 1, length(replace(substr({marks}, 1, {longest}), chr(1), ''))), '{_CONTROLS}', '?', 'g')"
    return f"CASE WHEN substr({marks}, {longest + 1}, 1) = chr(1) THEN regexp_replace(substr({marks}, 1, {longest}), '[^\\t\\n\\r\\x20-\\x7E]', '?', 'g') ELSE {whole} END"


def _fields(format: str) -> tuple[Query, str]:
    """What is shown of the metadata field that holds the whole text, and the field's size; of several, the first's value and all sizes."""
    section, place, name = _SHOWN[format]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = media_files(spark, sf_dir, format)
        rows = inspect.fields(made, "doc_id").filter((F.col("section") == section) & (F.col("name") == name))
        return rows.groupBy("doc_id", "section", "place", "name").agg(F.min_by("value", "seq").alias("value"), F.sum("size").alias("size"))

    text = "coalesce(text, '')"
    shown = {"gif": f"'c' || {text}", "jpeg": f"'Exif' || chr(0) || chr(0) || {text}", "png": text}.get(format, text if format in ("webp", "mp4") else f"rtrim({text}, ' ' || chr(0))")
    value = _head_sql("shown", inspect.PREVIEW if format in ("webp", "jpeg", "mp4") else inspect.LONGEST)
    if format in ("webp", "jpeg", "mp4"):
        first = f"left(shown, {synth.SEGMENT})"  # far beyond what is shown; texts are no controls
        value = f"CASE WHEN strlen(shown) > 0 AND strlen(regexp_replace({first}, '{_CONTROLS}', '', 'g')) * 10 >= strlen({first}) * 7 THEN {value} END"
    size = {"png": "n + 6", "gif": "n + 4 + (n + 255) // 255", "mp4": "n + 8", "raw": "greatest(n, 4) + 1", "jpeg": f"n + 6 * greatest(1, (n + {synth.SEGMENT - 1}) // {synth.SEGMENT})"}.get(format, "n")
    return query, f"""SELECT doc_id, '{section}' AS section, '{place}' AS place, '{name}' AS name, {value} AS value, ({size})::bigint AS size
        FROM (SELECT doc_id, {shown} AS shown, strlen({text})::bigint AS n FROM documents)"""


def heic_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inspect.fields(media_files(spark, sf_dir, "heic"), "doc_id").filter("section = 'items'")
    return rows.select("doc_id", F.col("detail")["id"].cast("long").alias("item"), F.col("detail")["type"].alias("type"), F.col("size"))


_HEIC_SQL = f"SELECT doc_id, 1::bigint AS item, 'mime' AS type, n AS size FROM {_SIZES} UNION ALL SELECT doc_id, 2, 'hvc1', m FROM {_SIZES}"


def cr3_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inspect.fields(media_files(spark, sf_dir, "cr3"), "doc_id").filter("section = 'timestamps'")
    return rows.select("doc_id", F.col("name").alias("box"), F.col("detail")["creation"].cast("long").alias("creation"), F.col("detail")["modification"].cast("long").alias("modification"))


_CR3_SQL = f"SELECT doc_id, 'mvhd' AS box, {0x11223344}::bigint AS creation, {0x55667788}::bigint AS modification FROM documents"


def _decided_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formats' parts as rows (format, id, size, action), actions by a join with the policy table. Documents are read once."""
    files.bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    each = F.array(*(F.struct(F.lit(f).alias("format"), content.alias("content")) for f, content in _made().items()))
    made = docs.select("doc_id", F.inline(each))
    policy = F.broadcast(strip.policy_table(spark).select("format", "role", "action"))  # about 150 rows
    default = policy.filter("role = '*'").select("format", F.col("action").alias("default"))
    joined = strip.scanned_parts(made, "doc_id").join(policy, ["format", "role"], "left").join(F.broadcast(default), "format", "left")
    joined = joined.withColumn("action", F.coalesce("action", F.when(F.col("role") != "info", F.col("default"))))
    return joined.filter("action is not null").select("format", "id", "size", "action")


def chunk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and bytes by format and action, by format, and in all."""
    return _decided_parts(spark, sf_dir).rollup("format", "action").agg(F.count("*").alias("parts"), F.sum("size").alias("bytes"))


def policy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formats' parts, joined with the policy table, and counted."""
    return _decided_parts(spark, sf_dir).groupBy("format", "id", "action").agg(F.count("*").alias("parts"), F.sum("size").alias("bytes"))


def _policy_sql() -> str:
    """The parts of EXPECTED as rows."""
    one = " UNION ALL ".join(f"SELECT '{f}' AS format, unnest(string_split({text}, ', ')) AS part, '{action}' AS action FROM {_SIZES}" for f, (kept, dropped, _) in EXPECTED.items() for text, action in ((kept, "keep"), (dropped, "drop")))
    return f"""SELECT format, CASE WHEN id = 'fmt' AND format = 'wav' THEN 'fmt ' ELSE id END AS id, action, count(*) AS parts, sum(bytes)::bigint AS bytes
        FROM (SELECT format, action, regexp_extract(part, '^(.*)\\(', 1) AS id, regexp_extract(part, '\\((\\d+)\\)$', 1)::bigint AS bytes FROM ({one})) GROUP BY ALL"""


_EXTENSIONS = [e for es in formats.EXTENSIONS.values() for e in es.split()] + ["pdf", "exe", "bin"]


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ext = F.element_at(F.array(*(F.lit(e) for e in _EXTENSIONS)), (F.col("doc_id") % len(_EXTENSIONS) + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.lit("/in/Doc."), F.col("doc_id").cast("string"), F.lit("."), F.when(F.col("doc_id") % 2 == 0, F.upper(ext)).otherwise(ext)).alias("path"))


_EXT_SQL = f"list_extract({_EXTENSIONS!r}, (doc_id % {len(_EXTENSIONS)} + 1)::int)"
_NAME_SQL = f"'Doc.' || doc_id || '.' || CASE WHEN doc_id % 2 = 0 THEN upper({_EXT_SQL}) ELSE {_EXT_SQL} END"
_FORMAT_SQL = f"CASE {' '.join(f'WHEN {_EXT_SQL} IN ({", ".join(repr(e) for e in es.split())}) THEN {k!r}' for k, es in formats.EXTENSIONS.items())} END"


def format_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", formats.format_of(F.col("path")).alias("format"), formats.is_text_path(F.col("path")).alias("is_text"))


def supported_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that can be cleaned, by a semi join with the table of extensions."""
    paths = _paths(spark, sf_dir).withColumn("ext", F.regexp_extract(F.lower("path"), r"(\.[^.]+)$", 1))
    return paths.join(F.broadcast(formats.extension_table(spark)), "ext", "left_semi").select("doc_id", "path")


def out_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", formats.out_path(F.col("path"), F.lit("/out/")).alias("out"))


def _mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files, WAV files, cut WAV files and GIF headers named as texts, by turns."""
    files.bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("wav", F.explode(F.array(_made()["wav"])))  # made once a row
    kind, wav = F.col("doc_id") % 4, F.col("wav")
    content = F.when(kind == 0, F.concat(F.lit("a\u200b"), F.coalesce("text", F.lit(""))).cast("binary")).when(kind == 1, wav).when(kind == 2, F.substr(wav, F.lit(1), F.octet_length(wav) - 2)).otherwise(F.lit(b"GIF89a"))
    made = docs.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), F.when(kind.isin(0, 3), "text").otherwise("wav").alias("format"), content.alias("content"))
    return saved(made, "mixed-files")  # files are read, not made again for each look at them


def batch_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = batch.process(_mixed_files(spark, sf_dir), "/out", dry_run=True)
    return batch.totals(done).select("ok", "failed", F.col("exit_code").cast("long").alias("exit_code"))


_TOTALS_SQL = "SELECT count(*) FILTER (doc_id % 4 IN (0, 1)) AS ok, count(*) FILTER (doc_id % 4 IN (2, 3)) AS failed, CASE WHEN count(*) FILTER (doc_id % 4 IN (2, 3)) > 0 THEN 2 ELSE 0 END::bigint AS exit_code FROM documents"


#: (format, error) of files that lack something, in the order of _broken.
BROKEN = (
    ("wav", "WAV has no fmt chunk"),
    ("wav", "WAV has no data chunk"),
    ("webp", "WebP has no image chunk (VP8/VP8L/VP8X)"),
    ("avi", "invalid AVI file (missing movi list)"),
    ("png", "invalid PNG file (first chunk is not IHDR)"),
    ("png", "invalid PNG file (bad or duplicate IHDR)"),
    ("png", "invalid PNG file (missing IDAT)"),
    ("png", "corrupt PNG chunk 'IDAT' (CRC mismatch)"),
    ("gif", "truncated GIF file (missing trailer)"),
    ("jpeg", "not a jpeg file (bad magic)"),
    ("mp4", "invalid MP4/MOV file (missing moov box)"),
    ("mkv", "file too small to be a mkv file"),
    ("heic", "invalid HEIC file (missing meta box)"),
    ("mkv", "invalid MKV/WebM file (missing Segment)"),
    ("jpeg", "JPEG missing scan or EOI marker"),
    ("cr3", "invalid CR3 file (missing moov box)"),
    ("exe", "unsupported format"),
)


def _broken(text: Column) -> tuple[Column, ...]:
    """The files of BROKEN; each holds the whole text, but for the shortest."""
    data = synth.bytes_of(text)
    fmt, info, sound = synth.riff_chunk(b"fmt ", synth.raw(bytes(16))), synth.riff_chunk(b"LIST", F.concat(synth.raw(b"INFO"), synth.riff_chunk(b"INAM", data))), synth.riff_chunk(b"data", data)
    head, ihdr = synth.raw(b"\x89PNG\r\n\x1a\n"), synth.png_chunk(b"IHDR", synth.raw(bytes(13)))
    idat, iend = synth.png_chunk(b"IDAT", data), synth.png_chunk(b"IEND", synth.raw(b""))
    ftyp = synth.box(b"ftyp", synth.raw(b"isom\0\0\2\0"))
    return (
        synth.riff(b"WAVE", info, sound),
        synth.riff(b"WAVE", fmt, info),
        synth.riff(b"WEBP", synth.riff_chunk(b"XMP ", data)),
        synth.riff(b"AVI ", info),
        F.concat(head, idat, ihdr, iend),
        F.concat(head, ihdr, ihdr, idat, iend),
        F.concat(head, ihdr, synth.png_chunk(b"tEXt", data), iend),
        F.concat(head, ihdr, F.substr(idat, F.lit(1), F.octet_length(idat) - 4), F.unhex(F.lpad(F.hex(F.crc32(idat)), 8, "0")), iend),
        F.substr(synth.gif(F.concat(F.lit("c"), F.coalesce(text, F.lit("")))), F.lit(1), F.octet_length(synth.gif(F.concat(F.lit("c"), F.coalesce(text, F.lit(""))))) - 1),
        F.concat(synth.raw(b"\xff\xd9\xff\xd8"), data),
        F.concat(ftyp, synth.box(b"mdat", data)),
        synth.raw(b"\x1a\x45"),
        F.concat(synth.box(b"ftyp", synth.raw(b"heic\0\0\0\0")), synth.box(b"mdat", data)),
        F.concat(synth.ebml(b"\x1a\x45\xdf\xa3", synth.raw(b"\x42\x86\x81\1")), synth.ebml(b"\xec", data)),
        F.concat(synth.raw(b"\xff\xd8\xff\xda\0\x08scanhd"), data, synth.raw(b" ")),
        F.concat(synth.box(b"ftyp", synth.raw(b"crx \0\0\0\1")), synth.box(b"mdat", data)),
        data,
    )


def media_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of files that lack a part that their format needs."""
    files.bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    case, format, content = F.col("doc_id") % len(BROKEN), F, F
    for k, ((name, _), data) in enumerate(zip(BROKEN, _broken(F.col("text")), strict=True)):
        format, content = format.when(case == k, F.lit(name)), content.when(case == k, data)
    made = docs.select("doc_id", F.explode(F.array(F.struct(format.alias("format"), content.alias("content")))).alias("f")).select("doc_id", "f.*")
    return strip.with_error(made).select("doc_id", "format", "error")


def _errors_sql() -> str:
    pick = lambda k: " ".join(f"""WHEN {n} THEN '{c[k].replace("'", "''")}'""" for n, c in enumerate(BROKEN))
    return f"SELECT doc_id, CASE doc_id % {len(BROKEN)} {pick(0)} END AS format, CASE doc_id % {len(BROKEN)} {pick(1)} END AS error FROM documents"


def skip_existing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that a rerun still has to do, where documents with a label are done."""
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").join(_paths(spark, sf_dir), "doc_id").select(F.regexp_replace("path", "^/in/", "/out/").alias("path"))
    return files.without_existing(_paths(spark, sf_dir), done).select("doc_id", "path")


def gps_decimal_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of rationals made from doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.format_string("%d/1 %d/1 %d/100", F.col("doc_id") % 90, F.col("doc_id") % 60, F.col("doc_id") % 6000)
    ref = F.when(F.col("doc_id") % 2 == 0, "N").otherwise("S")
    return docs.select("doc_id", F.round(inspect.degrees(text, ref, "S"), 9).alias("latitude"))


_GPS_SQL = "SELECT doc_id, round((CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) * ((doc_id % 90)::double + (doc_id % 60)::double / 60 + (doc_id % 6000)::double / 100 / 3600), 9) AS latitude FROM documents"


def png_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time chunk of PNG files that hold the whole text, with a date made from doc_id."""
    files.bounded_batches(spark)
    i, byte = F.col("doc_id"), lambda n: F.unhex(F.lpad(F.hex(n), 2, "0"))
    time = F.concat(synth.be16(2000 + i % 100), byte(i % 12 + 1), byte(i % 28 + 1), byte(i % 24), byte(i % 60), byte((i + 7) % 60))
    ends = (synth.png_chunk(b"IDAT", synth.raw(b"x")), synth.png_chunk(b"IEND", synth.raw(b"")))
    content = F.concat(synth.raw(b"\x89PNG\r\n\x1a\n"), synth.png_chunk(b"IHDR", synth.raw(bytes(13))), synth.png_chunk(b"tIME", time), synth.png_chunk(b"iTXt", synth.bytes_of(F.col("text"))), *ends)
    made = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("png").alias("format"), content.alias("content"))
    return inspect.fields(made, "doc_id").filter("section = 'time'").select("doc_id", F.col("value").alias("time"))


_TIME_SQL = "SELECT doc_id, format('{}-{:02}-{:02} {:02}:{:02}:{:02}', 2000 + doc_id % 100, doc_id % 12 + 1, doc_id % 28 + 1, doc_id % 24, doc_id % 60, (doc_id + 7) % 60) AS time FROM documents"


def mkv_date_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates made from doc_id, as decimals: from doc_id 106,765 on a long doesn't hold the nanoseconds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", inspect.ebml_date((F.col("doc_id").cast("decimal(19,0)") * 86_399 - 1_000_000) * 1_000_000_000).alias("iso"))


_DATE_SQL = "SELECT doc_id, strftime(TIMESTAMP '2001-01-01 00:00:00' + to_seconds(doc_id * 86399 - 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM documents"

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _name, (_query, _sql) in (
    *((f"{f}_strip_report", _report(f)) for f in EXPECTED),
    *((f"{f}_idempotent", _idempotent(f)) for f in EXPECTED),
    *((f"{f}_inspect", _fields(f)) for f in _SHOWN),
    ("heic_item_extents", (heic_items, _HEIC_SQL)),
    ("cr3_inspect", (cr3_times, _CR3_SQL)),
    ("policy_join", (policy_join, _policy_sql())),
    ("format_kind", (format_kind, f"SELECT doc_id, {_FORMAT_SQL} AS format, coalesce({_FORMAT_SQL} = 'text', false) AS is_text FROM documents")),
    ("supported_filter", (supported_filter, f"SELECT doc_id, '/in/' || {_NAME_SQL} AS path FROM documents WHERE {_FORMAT_SQL} IS NOT NULL")),
    ("out_path", (out_path, f"SELECT doc_id, '/out/' || {_NAME_SQL} AS out FROM documents")),
    ("batch_status_totals", (batch_status_totals, _TOTALS_SQL)),
    ("media_errors", (media_errors, _errors_sql())),
    ("skip_existing_anti", (skip_existing_anti, f"SELECT doc_id, '/in/' || {_NAME_SQL} AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")),
    ("gps_decimal_degrees", (gps_decimal_degrees, _GPS_SQL)),
    ("png_time", (png_time, _TIME_SQL)),
    ("chunk_rollup", (chunk_rollup, f"SELECT format, action, sum(parts)::bigint AS parts, sum(bytes)::bigint AS bytes FROM ({_policy_sql()}) GROUP BY ROLLUP (format, action)")),
    ("mkv_date_iso", (mkv_date_iso, _DATE_SQL)),
):
    QUERIES[_name], ORACLE_SQL[_name] = _query, _sql
