"""Whole batches of files: cleaning of any supported format, statuses and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.operators import strip, textclean
from sieveworks.operators.textclean import TextOptions
from sieveworks.sources import files, ranged
from sieveworks.sources.formats import out_path

_PARTS = "array<struct<id:string,size:bigint>>"


def _text_error(force_text: bool) -> Column:
    return F.when(F.col("content").isNull(), "no content").otherwise(textclean.text_error(F.col("content"), force_text))


def strip_text_files(found: DataFrame, options: TextOptions = textclean.DEFAULT, force_text: bool = False) -> DataFrame:
    """(path, format, content) rows of text files, cleaned: path, format, error, kept, dropped, content_out and bytes.

    Content that isn't UTF-8 or looks binary is an error; with force_text its bad bytes become U+FFFD.
    """
    error = _text_error(force_text)
    text = F.make_valid_utf8(F.col("content").cast("string")) if force_text else F.col("content").cast("string")
    rows = found.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), text))
    cleaned = textclean.clean(rows.filter("error is null").select("path", "text"), "path", "text", options)
    good = cleaned.select(
        "path",
        F.lit("text").alias("format"),
        F.lit(None).cast("string").alias("error"),
        F.array(F.struct(F.lit("text").alias("id"), F.col("bytes_out").alias("size"))).alias("kept"),
        "dropped",
        F.col("clean").cast("binary").alias("content_out"),
        "bytes_in",
        "bytes_out",
        (F.col("bytes_in") - F.col("bytes_out")).alias("bytes_saved"),
    )
    none, long = F.lit(None), F.lit(None).cast("long")
    size = F.octet_length("content").cast("long")
    bad = rows.filter("error is not null").select("path", "format", "error", none.cast(_PARTS).alias("kept"), none.cast(_PARTS).alias("dropped"), none.cast("binary").alias("content_out"), size.alias("bytes_in"), long.alias("bytes_out"), long.alias("bytes_saved"))
    return good.unionByName(bad)


def strip_files(found: DataFrame, options: TextOptions = textclean.DEFAULT, keep_musical: bool = False, force_text: bool = False) -> DataFrame:
    """(path, format, content) rows of any supported format, cleaned; columns as strip_text_files gives them."""
    media = strip.strip(found.filter("format != 'text'").select("path", "format", "content"), keep_musical).drop("content")
    texts = strip_text_files(found.filter("format = 'text'").select("path", "format", "content"), options, force_text)
    return media.unionByName(texts)


def checked(found: DataFrame, force_text: bool = False) -> DataFrame:
    """(path, error) of (path, format, content) rows: what cleaning would say of each file, without cleaning any."""
    media = strip.with_error(found.filter("format != 'text'")).select("path", "error")
    texts = found.filter("format = 'text'").select("path", _text_error(force_text).alias("error"))
    return media.unionByName(texts)


def process(found: DataFrame, out: str, options: TextOptions = textclean.DEFAULT, *, keep_musical: bool = False, force_text: bool = False, dry_run: bool = False, overwrite: bool = False, single_file: bool = False, verbose: bool | None = None, large: int = ranged.LARGE) -> DataFrame:
    """Cleans the files into the folder out, at once: (path, out, status, error). With dry_run nothing is written.

    With verbose given, a column line says what was kept and dropped, in full or (False) in short; only then are files
    cleaned in a dry run. Where found has a column length, films and sounds of more than ``large`` bytes are never read
    whole: their heads are read by ranges and their edits applied while they are copied.
    """
    target = out_path(F.col("path"), F.lit(out), single_file)
    shown = [] if verbose is None else ["line"]
    by_range = None
    if "length" in found.columns:
        big = F.coalesce(ranged.large(found, large), F.lit(False))
        by_range = ranged.analyze(found.filter(big).select("path", "format", "length"), keep_musical)
        found = found.filter(~big)
    dry = dry_run and verbose is None
    cleaned = checked(found, force_text) if dry else strip_files(found, options, keep_musical, force_text)

    def told(rows: DataFrame) -> DataFrame:
        return (rows if verbose is None else rows.withColumn("line", strip.result_line(verbose))).withColumn("out", target)

    cleaned = told(cleaned)
    if dry_run:
        rows = [cleaned, *([told(by_range)] if by_range is not None else [])]
        each = [r.select("path", "out", F.when(F.col("error").isNull(), files.DRY).otherwise(files.FAIL).alias("status"), "error", *shown) for r in rows]
        return reduce(DataFrame.unionByName, each)
    written = files.write_files(cleaned, overwrite, *shown)
    if by_range is None or by_range.isEmpty():
        return written
    return written.unionByName(files.write_files(told(by_range), overwrite, *shown, stage=ranged.stage))


def totals(statuses: DataFrame) -> DataFrame:
    """One row: how many files went well (skipped ones do) and failed, and the exit code: 2 with failures, else 0."""
    failed = F.count_if(F.col("status") == files.FAIL)
    return statuses.agg((F.count("*") - failed).alias("ok"), failed.alias("failed"), F.when(failed > 0, 2).otherwise(0).alias("exit_code"))
