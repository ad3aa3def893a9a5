"""``python -m sieveworks INPUT --out DIR``: cleans or inspects files with Spark."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import batch, inspect, textclean
from sieveworks.operators.textclean import TextOptions
from sieveworks.sources.files import read_files
from sieveworks.sources.shared import saved

VERSION = "0.1.0"
FLAGS = ("dry-run", "inspect", "verbose", "overwrite", "keep-musical", "nfkc", "aggressive-homoglyphs", "no-normalize-spaces", "strip-emoji-glue", "strip-bidi", "force-text")


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.print_usage(sys.stderr)
        self.exit(1, f"error: {message}\n")


def parser() -> argparse.ArgumentParser:
    out = _Parser("sieveworks", description="Removes metadata from media files and invisible code points from texts.")
    out.add_argument("input", help="a file or a folder, which isn't descended into")
    out.add_argument("--out", "-o", default="", help="folder (or, for one file, file) to write to; not needed with --inspect")
    for flag in FLAGS:
        out.add_argument(f"--{flag}", action="store_true")
    out.add_argument("--version", action="version", version=VERSION)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: all went well, 1: the call was wrong, 2: some file failed."""
    args = parser().parse_args(argv)
    if not args.out and not args.inspect:
        parser().error("--out is needed")
    spark = spark or SparkSession.builder.appName("sieveworks").getOrCreate()
    options = TextOptions(not args.no_normalize_spaces, args.aggressive_homoglyphs, args.strip_emoji_glue, args.strip_bidi, args.nfkc)
    try:
        found = read_files(spark, args.input)
        if found.isEmpty():
            parser().error("no supported files")
    except AnalysisException:
        parser().error(f"no such input: {args.input}")
    if args.inspect:
        cleaned = batch.strip_files(found, options, args.keep_musical, args.force_text).select("path", "format", "bytes_in", "dropped", "error")
        media = inspect.trees(found.filter("format != 'text'"), "path", args.keep_musical).select("path", "metadata")
        texts = found.filter("format = 'text'").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        hits = textclean.hits(texts, "path", "text", options).groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "cp", "codepoint", "kind", "confidence", "count", "sample_offsets")))).alias("hits"))
        totals = textclean.report(texts, "path", "text", options)
        shown = cleaned.join(media, "path", "left").join(totals, "path", "left").join(hits, "path", "left")
        for line in shown.orderBy("path").select(F.to_json(F.struct(*shown.columns))).toLocalIterator():
            print(line[0])
        return 2 if not cleaned.filter("error is not null").isEmpty() else 0
    single = found.limit(2).count() == 1
    done = batch.process(found, args.out, options, verbose=args.verbose, keep_musical=args.keep_musical, force_text=args.force_text, dry_run=args.dry_run, overwrite=args.overwrite, single_file=single)
    done = saved(done, "statuses")  # files are read, cleaned and written in this one run
    for row in done.orderBy("path").toLocalIterator():
        print(row.status, row.path, row.line, sep="\n  ")
    result = batch.totals(done).first()
    print(f"done: {result.ok} ok, {result.failed} failed")
    return result.exit_code


if __name__ == "__main__":
    sys.exit(main())
