"""File formats by extension, and what a file of each must start with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions of each format.
EXTENSIONS = {
    "wav": "wav",
    "jpeg": "jpg jpeg",
    "png": "png",
    "gif": "gif",
    "webp": "webp",
    "mp4": "mp4 mov m4v",
    "avi": "avi",
    "mkv": "mkv webm",
    "raw": "cr2 nef nrw arw srf dng rw2 orf pef srw tif tiff",
    "cr3": "cr3",
    "heic": "heic heif hif",
    "text": "txt text md markdown json csv html htm xml yaml yml",
}
# Smallest size, and (offset, hex) of bytes that must match one of the given.
MAGIC: dict[str, tuple[int, tuple[tuple[int, tuple[str, ...]], ...]]] = {
    "wav": (12, ((0, ("52494646",)), (8, ("57415645",)))),
    "webp": (12, ((0, ("52494646",)), (8, ("57454250",)))),
    "avi": (12, ((0, ("52494646",)), (8, ("41564920",)))),
    "jpeg": (4, ((0, ("FFD8",)),)),
    "png": (8, ((0, ("89504E470D0A1A0A",)),)),
    "gif": (13, ((0, ("474946383761", "474946383961")),)),
    "mp4": (16, ((4, ("66747970",)),)),
    "mkv": (8, ()),
    "raw": (8, ((0, ("4949", "4D4D")),)),
    "cr3": (12, ((4, ("66747970",)), (8, ("63727820",)))),
    "heic": (12, ((4, ("66747970",)), (8, tuple(x.encode().hex().upper() for x in "heic heix hevc hevx heim heis hevm hevs mif1 msf1 msf2".split())))),
}


def extension_table(spark: SparkSession) -> DataFrame:
    """(ext, format), a row for each supported extension; a few dozen rows, so it may be broadcast."""
    return spark.createDataFrame([(f".{e}", k) for k, es in EXTENSIONS.items() for e in es.split()], "ext string, format string")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def format_of(path: Column) -> Column:
    """The format by the extension in any case; null: not supported."""
    ext = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)
    out = F
    for name, extensions in EXTENSIONS.items():
        out = out.when(ext.isin(*extensions.split()), F.lit(name))
    return out


def is_text_path(path: Column) -> Column:
    return F.coalesce(format_of(path) == "text", F.lit(False))


def out_path(path: Column, out: Column, single_file: bool = False) -> Column:
    """Where the result of path goes: out itself if it is a supported file and the input one file, else out/name."""
    inside = F.concat_ws("/", F.regexp_replace(out, "/+$", ""), file_name(path))
    return F.when(format_of(out).isNotNull(), out).otherwise(inside) if single_file else inside


def magic_error(format: Column, content: Column) -> Column:
    """Why content can't be of the format, by its size and first bytes alone; null: it may be."""
    head, out = F.hex(F.substring(content, 1, 12)), F
    for name, (least, places) in MAGIC.items():
        bad = F.lit(False)
        for at, any_of in places:
            bad = bad | ~F.substring(head, 2 * at + 1, len(any_of[0])).isin(*any_of)
        why = F.when(F.octet_length(content) < least, F.lit(f"file too small to be a {name} file")).when(bad, F.lit(f"not a {name} file (bad magic)"))
        out = out.when(format == name, why)
    return out
