"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm.common import saved, sliced

#: An archive is closed past this size, and an index block after so many lines.
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 1000
#: Records that a task holds at once on reading.
RECORDS = 200
CAPTURED = "2020-01-01T00:00:00Z"
ID = "urn:sieveworks:page:"
INDEX = "key string, page_id long, url string, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://WWW.a.example:80/p?q#f`` is ``example,a,www)/p?q``; what is no URL stands as it is, null is empty."""
    url = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    if not (m := _URL.match(url)):
        return url
    host = m[1].rpartition("@")[2].lower()
    host, _, port = host.partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (m[2] if m[2][:1] == "/" else "/" + m[2])


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit holds the HTTP head alone, which keeps the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {CAPTURED}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n") + gz.flush()


def parse_record(member: bytes) -> tuple:
    """A row of RECORD from a gzip member."""
    data = zlib.decompress(member, 31)
    top, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in top.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    head, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    number = lambda v: int(v[len(ID) + 1 : -1]) if v and v[len(ID) + 1 : -1] else None
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], number(fields.get("WARC-Refers-To")), payload


def _opened(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, digest hex, refers_to): of equal payloads of at least `least` bytes the largest page_id is the response."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    firsts = p.filter(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    j = p.join(firsts.drop("n").hint("merge"), "digest", "left")
    refers = F.when((F.length("payload") >= least) & (F.col("page_id") != F.col("response")), F.col("response"))
    return j.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of with_revisits() to archives below folder; returns the captures (INDEX), read from a table.

    A task writes its own files, named by its attempt: a task that runs again writes new ones, and only files of the
    attempt that Spark commits are in the table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _opened(folder)
        fs.create_dir(base, recursive=True)
        task, number, out, name, at = TaskContext.get(), 0, None, "", 0
        try:
            for pdf in sliced(batches):
                rows = []
                for page, url, payload, digest, refers in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["refers_to"], strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{task.partitionId():05d}-{task.taskAttemptId()}-{number}.warc.gz"
                        out, at, number = fs.open_output_stream(f"{base}/{name}", compression=None), 0, number + 1
                    page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                    data = record_bytes(page, url, bytes(payload), base64.b32encode(bytes.fromhex(digest)).decode(), refers)
                    out.write(data)
                    rows.append((url_key(url), page, url, name, at, len(data)))
                    at += len(data)
                found = pd.DataFrame(rows, columns=["key", "page_id", "url", "file", "offset", "length"])
                yield found.astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return saved(records.mapInPandas(run, INDEX), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the captures, sorted by key, as compressed blocks below folder; returns the parts, one row a file.

    (part, file, first_key, last_key, offset, length): a file ends with its sparse block directory, which lies at
    offset. Parts are ranges of keys, dealt by (key, page_id), so a host or key with very many pages spans several.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _opened(folder)
        fs.create_dir(base, recursive=True)
        task, lines, blocks, at = TaskContext.get(), [], [], 0
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}.idx"
        out = fs.open_output_stream(f"{base}/{name}", compression=None)

        def block() -> None:
            nonlocal at
            data = _packed(line for _, line in lines)
            out.write(data)
            blocks.append((lines[0][0], lines[-1][0], at, len(data)))
            at += len(data)
            lines.clear()

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                lines.append((r.key, f"{r.key}\t{r.file}\t{r.offset}\t{r.length}\n"))
                if len(lines) == block_lines:
                    block()
        if lines:
            block()
        directory = _packed(f"{first}\t{last}\t{offset}\t{size}\n" for first, last, offset, size in blocks)
        out.write(directory)
        out.close()
        rows = [(task.partitionId(), name, blocks[0][0], blocks[-1][1], at, len(directory))] if blocks else []
        yield pd.DataFrame(rows, columns=["part", "file", "first_key", "last_key", "offset", "length"])

    ordered = captures.select("key", "page_id", "file", "offset", "length").orderBy("key", "page_id", "file", "offset")
    return saved(ordered.mapInPandas(run, "part int, file string, first_key string, last_key string, offset long, length long"), "directory")


def _packed(lines: Iterator[str]) -> bytes:
    return zlib.compress("".join(lines).encode("utf-8", "surrogatepass"), 6)


def _lines(data: bytes) -> list[list[str]]:
    return [line.rsplit("\t", 3) for line in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")[:-1]]


def _ranged(fs, base: str, wanted: Iterator[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes of (file, offset, length); a file stays open while its rows follow each other."""
    name, source = None, None
    for file, offset, length in wanted:
        if file != name:
            if source is not None:
                source.close()
            name, source = file, fs.open_input_file(f"{base}/{file}")
        source.seek(offset)
        yield source.read(length)
    if source is not None:
        source.close()


def lookup(urls: DataFrame, directory: DataFrame, index_folder: str, folder: str) -> DataFrame:
    """The captures of each distinct key of urls (url; null: the empty key), as (key, RECORD).

    The driver holds one row a part (as many as index files). Tasks of neighbouring keys binary-search the parts, then
    a part's block directory, which they read once; each block with wanted keys is read once for all of them; records
    are range reads in the order of their place. A key with very many captures is dealt by block, then by archive.
    """
    parts = sorted(directory.collect(), key=lambda r: r["part"])
    firsts, lasts = [r["first_key"] for r in parts], [r["last_key"] for r in parts]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": [url_key(u) for u in pdf["url"]]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _opened(index_folder)
        now, block_firsts, block_lasts, places = None, [], [], []
        for pdf in batches:
            rows = []
            for key in pdf["key"]:
                k = bisect_left(lasts, key)
                while k < len(parts) and firsts[k] <= key:
                    if k != now:
                        now, wanted = k, (parts[k]["file"], parts[k]["offset"], parts[k]["length"])
                        blocks = _lines(next(_ranged(fs, base, iter([wanted]))))
                        block_firsts, block_lasts = [b[0] for b in blocks], [b[1] for b in blocks]
                        places = [(int(b[2]), int(b[3])) for b in blocks]
                    at = bisect_left(block_lasts, key)
                    while at < len(places) and block_firsts[at] <= key:
                        rows.append((key, parts[k]["file"], *places[at]))
                        at += 1
                    k += 1
            yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _opened(index_folder)
        now, held = None, {}
        for pdf in batches:
            rows = []
            for key, *place in zip(pdf["key"], pdf["file"], pdf["offset"].tolist(), pdf["length"].tolist(), strict=True):
                if place != now:
                    now, held = place, {}
                    for k, file, offset, length in _lines(next(_ranged(fs, base, iter([place])))):
                        held.setdefault(k, []).append((file, int(offset), int(length)))
                rows += [(key, *capture) for capture in held.get(key, ())]
            yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _opened(folder)
        for pdf in sliced(batches, RECORDS):
            found = _ranged(fs, base, zip(pdf["file"], pdf["offset"].tolist(), pdf["length"].tolist(), strict=True))
            out = pd.DataFrame([(k, *parse_record(x)) for k, x in zip(pdf["key"], found, strict=True)], columns=["key", *(c.split()[0] for c in RECORD.split(", "))])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    place = "key string, file string, offset long, length long"
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = urls.select("url").distinct().mapInPandas(keyed, "key string").distinct().repartitionByRange("key").sortWithinPartitions("key")
    blocks = wanted.mapInPandas(search, place).repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
    # records are large and their places small, so these partitions aren't merged by the places' size
    captures = blocks.mapInPandas(unpack, place).repartition(tasks, "file", F.shiftright("offset", 24)).sortWithinPartitions("file", "offset")
    return captures.mapInPandas(read, f"key string, {RECORD}")


def round_trip(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) below folder with its index, and looks up every url again (RECORD).

    Payload: html in UTF-8, null is empty. Of equal payloads of at least `least` bytes the row with the largest
    page_id is the response and the others are revisits that refer to it; smaller payloads are all responses.

    Null page_id: a response, its id null on reading. Null url: no target URI, key empty. Repeated rows: a record
    each. Line ends in a url are percent-encoded. An empty table gives an empty result; other columns are ignored.
    """
    captures = write_archives(with_revisits(pages, least), f"{folder}/archive")
    directory = write_index(captures, f"{folder}/index")
    return lookup(pages, directory, f"{folder}/index", f"{folder}/archive").drop("key")


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
