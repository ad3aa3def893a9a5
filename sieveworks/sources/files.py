"""Files in and out: listing and reading by path, and writing cleaned files from the executors."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveworks.sources.formats import file_name, format_of
from sieveworks.sources.shared import saved

#: Bytes of an Arrow batch of files that cross into Python at once; what is made of them takes several times that, in each task.
BATCH_BYTES = 8 << 20
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def bounded_batches(spark: SparkSession) -> None:
    """Files are large: batches for Python are bounded by bytes, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, format, length, content) of the supported files at path, a file or a folder; others are left out.

    A folder isn't descended into unless recursive. content is only read where a plan uses it. A path that isn't
    there fails when the plan is made.
    """
    bounded_batches(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return supported(found)


def supported(files: DataFrame) -> DataFrame:
    """binaryFile rows with their format, without those of formats that aren't known."""
    named = files.withColumn("format", format_of(file_name(F.col("path"))))
    return named.filter("format is not null").select("path", "format", "length", "content")


def inputs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, format, length) of what read_files would read, ordered by path, without reading it."""
    return read_files(spark, path, recursive).drop("content").orderBy("path")


def without_existing(files: DataFrame, existing: DataFrame) -> DataFrame:
    """The files whose name isn't among those of existing (path): what a rerun still has to do."""
    done = existing.select(file_name(F.col("path")).alias("_name")).distinct()
    return files.withColumn("_name", file_name(F.col("path"))).join(done, "_name", "left_anti").drop("_name")


OK, SKIP, FAIL, DRY = "OK", "SKIP", "FAIL", "DRY"


def store_of(path: str):
    """(store, path in it) of a URI; what Spark writes as ``file:/x`` is ``file:///x``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def staging_dir(out: str, job: str) -> str:
    return f"{out.rpartition('/')[0]}/.{job}"


def staged(job: str, out: str, overwrite: bool, error: str | None, pieces: Iterable[bytes] | None) -> tuple[str | None, str, str | None]:
    """Writes a file's pieces to a name that no other attempt has: (part, status, error)."""
    from pyarrow import fs

    if error is not None or pieces is None:
        return None, FAIL, error or "no content"
    try:
        store, target = store_of(out)
        if not overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
            return None, SKIP, None
        folder = staging_dir(target, job)
        store.create_dir(folder, recursive=True)
        part = f"{folder}/{uuid.uuid4().hex}"
        with store.open_output_stream(part) as stream:
            for piece in pieces:
                stream.write(piece)
    except OSError as why:
        return None, FAIL, str(why)
    return part, OK, None


def _stage_contents(batches: Iterator[pd.DataFrame], job: str, overwrite: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [staged(job, out, overwrite, error, None if content is None else [content]) for out, content, error in zip(pdf["out"], pdf["content_out"], pdf["error"], strict=True)]
        yield pdf.drop(columns=["content_out", "error"]).assign(part=[f[0] for f in found], status=[f[1] for f in found], error=[f[2] for f in found])


def _moved(batches: Iterator[pd.DataFrame], overwrite: bool) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    def move(out: str, part: str) -> tuple[str, str | None]:
        try:
            store, target = store_of(out)
            if store.get_file_info(part).type != fs.FileType.NotFound:
                if overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
                    store.delete_file(target)
                store.move(part, target)
            elif store.get_file_info(target).type == fs.FileType.NotFound:
                return FAIL, "the staged file is gone"
        except OSError as why:
            return FAIL, str(why)
        return OK, None  # moved now, or by a run of this task that was lost after it

    for pdf in batches:
        found = [(status, error) if status != OK or not mine else move(out, part) for out, part, mine, status, error in zip(pdf["out"], pdf["part"], pdf["mine"], pdf["status"], pdf["error"], strict=True)]
        yield pdf.drop(columns=["part", "mine"]).assign(status=[f[0] for f in found], error=[f[1] for f in found])


def write_files(cleaned: DataFrame, overwrite: bool = False, *carried: str, stage: Callable | None = None) -> DataFrame:
    """Writes content_out to out for every row of (path, out, content_out, error); gives (path, out, status, error) and carried strings.

    It writes at once, in two steps, as a committer does. First each task stages its files, each under a name that no
    other attempt has, in a hidden folder beside their target; which names count is a saved table, for which Spark
    keeps one attempt of each task. Then a second job moves the staged files that the table names to their targets. A
    task of either that runs again changes nothing in the result: an earlier attempt's files aren't in the table, and
    a move that was made is seen as made. Last the hidden folders go, and so they do when a job fails; no target is
    touched before all files are staged.

    out must be on a store that all machines share. A file that was there before is skipped unless overwrite. Of rows
    with one target the first by path is written and the others are skipped; with overwrite the last by path remains
    and all are well. stage: what stages batches, given (batches, job, overwrite), in place of content_out's writer.
    """
    bounded_batches(cleaned.sparkSession)
    job, stage = f"staged-{uuid.uuid4().hex}", stage or _stage_contents
    source = [c for c in ("content_out", "format", "edits") if c in cleaned.columns and c not in carried]
    rows = cleaned.select("path", "out", *source, "error", *carried)
    shown = ("path", "out", *carried)
    parts = ", ".join(f"{c} string" for c in (*shown, "part", "status", "error"))
    manifest = None
    try:
        manifest = saved(rows.mapInPandas(lambda batches: (pdf[[*shown, "part", "status", "error"]] for pdf in stage(batches, job, overwrite)), parts), "staged-files")
        rank = F.row_number().over(Window.partitionBy("out").orderBy(F.desc("path") if overwrite else F.asc("path"), "part"))
        mine = F.when(F.col("status") == OK, rank == 1).otherwise(F.lit(False))
        told = manifest.filter(F.col("status") == OK).withColumn("mine", mine).unionByName(manifest.filter(F.col("status") != OK).withColumn("mine", F.lit(False)))
        if not overwrite:
            told = told.withColumn("status", F.when(F.col("mine") | (F.col("status") != OK), F.col("status")).otherwise(SKIP))
        done = ", ".join(f"{c} string" for c in (*shown, "status", "error"))
        return saved(told.select(*shown, "part", "status", "error", "mine").mapInPandas(lambda batches: (pdf[[*shown, "status", "error"]] for pdf in _moved(batches, overwrite)), done), "written-files")
    finally:
        told_of = cleaned if manifest is None else manifest  # only a failed first job needs the plan once more
        folders = told_of.select(F.regexp_replace("out", "/[^/]*$", "").alias("folder")).distinct()
        for row in folders.toLocalIterator():  # as many as there are output folders
            store, folder = store_of(row.folder)
            with contextlib.suppress(OSError):
                store.delete_dir(f"{folder}/.{job}")
