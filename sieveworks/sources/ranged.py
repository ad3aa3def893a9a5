"""Files too large to hold: their parts are read by ranges, and their edits applied while a copy streams."""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sieveworks.operators import strip
from sieveworks.sources import files, flat, tree
from sieveworks.sources.formats import magic_error
from sieveworks.sources.units import UNITS, Malformed

#: Bytes from which on a file of a ranged format isn't read whole; of a block that is read, and how many are kept; of a piece that is copied.
LARGE, BLOCK, KEPT, PIECE = 256 << 20, 64 << 10, 32, 4 << 20
#: Formats whose readers look at heads of parts alone, so that their payloads need not be read.
READERS = {"wav": flat.wav, "avi": flat.avi, "mp4": tree.mp4, "mkv": tree.mkv}
HEAD = 64


class Ranges:
    """A file as a sequence of bytes that reads a block when it is asked for one, and keeps the last few."""

    def __init__(self, stream, size: int) -> None:
        self._stream, self._size = stream, size
        self._blocks: OrderedDict[int, bytes] = OrderedDict()

    def __len__(self) -> int:
        return self._size

    def _block(self, k: int) -> bytes:
        if k in self._blocks:
            self._blocks.move_to_end(k)
        else:
            self._stream.seek(k * BLOCK)
            self._blocks[k] = self._stream.read(min(BLOCK, self._size - k * BLOCK))
            if len(self._blocks) > KEPT:
                self._blocks.popitem(last=False)
        return self._blocks[k]

    def __getitem__(self, at: int | slice) -> int | bytes:
        if isinstance(at, slice):
            start, stop, _ = at.indices(self._size)
            blocks = (self._block(k) for k in range(start // BLOCK, -(-stop // BLOCK))) if start < stop else ()
            return b"".join(blocks)[start % BLOCK : start % BLOCK + stop - start]
        at = at + self._size if at < 0 else at
        if not 0 <= at < self._size:
            raise IndexError(at)
        return self._block(at // BLOCK)[at % BLOCK]


def opened(path: str):
    store, place = files.store_of(path)
    return store.open_input_file(place)


@pandas_udf(T.StructType().add("units", UNITS).add("error", "string").add("head", "binary"))
def scan_ranges(format: pd.Series, path: pd.Series) -> pd.DataFrame:
    """The parts of each file and its first bytes, of which only blocks with heads of parts are read."""
    rows = []
    for kind, place in zip(format, path, strict=True):
        head = None
        try:
            with opened(place) as stream:
                data = Ranges(stream, stream.size())
                head = data[:HEAD]
                rows.append(([u._replace(zones=[{"at": a, "len": n} for a, n in u.zones])._asdict() for u in READERS[kind](data)], None, head))
        except (Malformed, RecursionError, OSError) as why:
            rows.append((None, str(why), head))
    return pd.DataFrame(rows, columns=["units", "error", "head"])


def pieces(stream, size: int, edits: list[dict]) -> Iterator[bytes]:
    """The file after its edits (at, len, put; null put: zeros), a piece at a time.

    Edits that keep their length are laid over the copy in order; the others replace what they span, as for whole files.
    """
    over = [e for e in edits if e["put"] is None or len(e["put"]) == e["len"]]
    moves = sorted(((e["at"], e["len"], bytes(e["put"])) for e in edits if e["put"] is not None and len(e["put"]) != e["len"]), key=lambda m: m[:2])
    ordered = sorted(range(len(over)), key=lambda k: over[k]["at"])
    starts = [over[k]["at"] for k in ordered]
    ends, most = [], 0
    for k in ordered:  # the furthest end so far, to know where earlier edits may still reach
        most = max(most, over[k]["at"] + over[k]["len"])
        ends.append(most)

    def copied(at: int, stop: int) -> Iterator[bytes]:
        for low in range(at, stop, PIECE):
            high = min(low + PIECE, stop)
            stream.seek(low)
            piece = bytearray(stream.read(high - low))
            near = ordered[bisect_right(ends, low) : bisect_right(starts, high - 1)]
            for k in sorted(near):
                e = over[k]
                a, b = max(e["at"], low), min(e["at"] + e["len"], high)
                if a < b:
                    piece[a - low : b - low] = bytes(b - a) if e["put"] is None else e["put"][a - e["at"] : b - e["at"]]
            yield bytes(piece)

    at = 0
    for start, n, put in moves:
        yield from copied(at, start)
        if put:
            yield put
        at = start + n
    yield from copied(at, size)


def large(found: DataFrame, least: int = LARGE):
    """Which rows of (format, length) aren't read whole, as a Column."""
    return F.col("format").isin(*READERS) & (F.col("length") > least)


def analyze(found: DataFrame, keep_musical: bool = False) -> DataFrame:
    """strip.analyze() of (path, format, length) rows by range reads, with ``edits``: what write_files() of stage() needs."""
    scanned = found.select("path", "format", "length", scan_ranges("format", "path").alias("scan"))
    early = magic_error(F.col("format"), F.col("scan.head"))
    error = F.coalesce(early, F.col("scan.error"), strip.structure_error(F.col("format"), F.col("scan.units")))
    units = strip.decided(scanned.withColumns({"error": error, "scanned": F.col("scan.units")}).drop("scan"), keep_musical)
    out = strip.with_report(units).withColumn("edits", strip.edits(F.col("format"), F.col("units"))).drop("units")
    size = strip.bytes_out(F.col("length"), F.col("edits"))
    return out.withColumns({"bytes_in": F.col("length"), "bytes_out": F.when(F.col("error").isNull(), size)}).withColumn("bytes_saved", F.col("bytes_in") - F.col("bytes_out"))


def stage(batches: Iterator[pd.DataFrame], job: str, overwrite: bool) -> Iterator[pd.DataFrame]:
    """For write_files(): the files at path, their edits applied while they are copied."""

    def changed(path: str, edits) -> Iterator[bytes]:
        with opened(path) as stream:
            yield from pieces(stream, stream.size(), [dict(e) for e in edits])

    for pdf in batches:
        found = [files.staged(job, out, overwrite, error, None if edits is None else changed(path, edits)) for path, out, edits, error in zip(pdf["path"], pdf["out"], pdf["edits"], pdf["error"], strict=True)]
        yield pdf.drop(columns=["edits", "error"]).assign(part=[f[0] for f in found], status=[f[1] for f in found], error=[f[2] for f in found])
