from __future__ import annotations

import os
import subprocess
import sys
import textwrap
import tracemalloc
from pathlib import Path

import media
import pytest
from media import box, chunk, element, riff

from sieveworks.operators import batch
from sieveworks.sources import files, ranged



def wide(code, data):
    """An element with a size of two bytes."""
    return bytes.fromhex(code) + (0x4000 | len(data)).to_bytes(2, "big") + data


UDTA = box(b"udta", box(b"meta", b"secret"))
FILES = {
    "a.wav": riff(b"WAVE", chunk(b"fmt ", bytes(16)), chunk(b"LIST", b"INFO" + chunk(b"INAM", b"abc")), chunk(b"id3 ", b"x" * 301), chunk(b"data", b"s" * 5001)),
    "b.avi": riff(b"AVI ", chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(12))), chunk(b"LIST", b"INFO" + chunk(b"IART", b"Jane")), chunk(b"LIST", b"movi" + chunk(b"00dc", b"v" * 3000)), chunk(b"DISP", b"d" * 9)),
    "c.mp4": box(b"ftyp", b"isom\0\0\2\0") + box(b"moov", media.MVHD, UDTA) + box(b"mdat", b"m" * 4000) + UDTA,
    "d.mkv": media.mkv(element("1549A966", element("7BA9", b"Film"), element("4D80", b"app")), wide("1254C367", b"t" * 500), wide("1F43B675", b"c" * 2000)),
    "e.mp4": box(b"ftyp", b"isom\0\0\2\0") + box(b"mdat", b"m" * 2000),
    "f.mp4": b"no film" * 300,
    "g.mkv": media.mkv(element("1549A966", element("7BA9", b"Film")))[:-1] + b"\x1f" * 2000,
}


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, data in FILES.items():
        (source / name).write_bytes(data)
    return source


def names(folder):
    return sorted(p.name for p in Path(folder).iterdir())


def test_ranges_equal_whole_files(spark, folder, tmp_path, monkeypatch):
    found = files.read_files(spark, str(folder))
    whole = {r.path: r for r in batch.process(found, f"file://{tmp_path}/whole", verbose=True).collect()}
    parts = {r.path: r for r in batch.process(found, f"file://{tmp_path}/parts", verbose=True, large=100).collect()}
    assert parts.keys() == whole.keys() and len(parts) == len(FILES)
    for path, r in whole.items():
        assert (parts[path].status, parts[path].error, parts[path].line) == (r.status, r.error, r.line)
    assert names(tmp_path / "whole") == names(tmp_path / "parts") == ["a.wav", "b.avi", "c.mp4", "d.mkv"]
    for name in names(tmp_path / "whole"):
        assert (tmp_path / "parts" / name).read_bytes() == (tmp_path / "whole" / name).read_bytes() != FILES[name]
    dry = {r.path: (r.status, r.error) for r in batch.process(found, "file:///nowhere", dry_run=True, large=100).collect()}
    assert dry == {p: ("DRY" if r.status == "OK" else r.status, r.error) for p, r in whole.items()}


def test_edits_across_pieces(monkeypatch):
    import io
    import random

    rng = random.Random(1)
    monkeypatch.setattr(ranged, "PIECE", 7)
    for _ in range(200):
        data = bytes(rng.randrange(1, 256) for _ in range(60))
        over = [{"at": (a := rng.randrange(50)), "len": (n := rng.randrange(1, 60 - a)), "put": None if rng.random() < 0.5 else bytes(rng.randrange(256) for _ in range(n))} for _ in range(rng.randrange(4))]
        cuts = sorted(rng.sample(range(60), 4))
        moves = [{"at": cuts[k], "len": rng.randrange(0, cuts[k + 1] - cuts[k]), "put": b"1234567890"} for k in range(3)] if rng.random() < 0.5 else []
        moves = [m for m in moves if m["len"] != 10]
        want, tail = bytearray(data), []
        for e in over:
            want[e["at"] : e["at"] + e["len"]] = bytes(e["len"]) if e["put"] is None else e["put"]
        at = 0
        for m in moves:
            tail += [bytes(want[at : m["at"]]), m["put"]]
            at = m["at"] + m["len"]
        assert b"".join(ranged.pieces(io.BytesIO(data), len(data), over + moves)) == b"".join(tail) + bytes(want[at:])


def test_a_large_file_takes_little_memory(tmp_path):
    path, size = tmp_path / "film.mp4", 600 << 20
    with path.open("wb") as f:
        f.write(box(b"ftyp", b"isom\0\0\2\0") + box(b"moov", media.MVHD, UDTA))
        f.write((1).to_bytes(4, "big") + b"mdat" + (size + 16).to_bytes(8, "big"))
        f.seek(size, os.SEEK_CUR)
        f.write(UDTA)
    tracemalloc.start()
    with ranged.opened(f"file:{path}") as stream:
        data = ranged.Ranges(stream, stream.size())
        units = list(ranged.READERS["mp4"](data))
        assert [u.id for u in units] == ["ftyp", "moov", "mvhd", "udta", "mdat", "udta"]
        last = units[-1]
        edits = [{"at": last.start + 4, "len": 4, "put": b"free"}, {"at": last.body, "len": last.stop - last.body, "put": None}]
        out = tail = 0
        for piece in ranged.pieces(stream, stream.size(), edits):
            out, tail = out + len(piece), piece[-len(UDTA) :]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out == path.stat().st_size and tail == UDTA[:4] + b"free" + bytes(len(UDTA) - 8) and peak < 32 << 20


def test_targets_that_meet(spark, tmp_path):
    df = spark.createDataFrame([("b", f"file://{tmp_path}/o/x", bytearray(b"second"), None), ("a", f"file://{tmp_path}/o/x", bytearray(b"first"), None), ("c", f"file://{tmp_path}/o/y", None, "bad")], "path string, out string, content_out binary, error string")
    assert {r.path: r.status for r in files.write_files(df).collect()} == {"a": "OK", "b": "SKIP", "c": "FAIL"}
    assert (tmp_path / "o/x").read_bytes() == b"first" and names(tmp_path / "o") == ["x"]
    assert {r.path: r.status for r in files.write_files(df).collect()} == {"a": "SKIP", "b": "SKIP", "c": "FAIL"}
    assert {r.path: r.status for r in files.write_files(df, True).collect()} == {"a": "OK", "b": "OK", "c": "FAIL"}
    assert (tmp_path / "o/x").read_bytes() == b"second" and names(tmp_path / "o") == ["x"]


FAILING = """
    import os, sys
    from pyspark import TaskContext
    from pyspark.sql import SparkSession
    from sieveworks.sources import files
    out = sys.argv[1]
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{out}/shared").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    df = spark.createDataFrame([(str(k), f"file://{out}/o/{k}", bytearray(b"x%d" % k), None) for k in range(6)], "path string, out string, content_out binary, error string").coalesce(1)

    def once(what, attempts):
        def run(batches, *more):
            for pdf in what(batches, *more):
                yield pdf
                if TaskContext.get().attemptNumber() < attempts:
                    raise RuntimeError("lost after it wrote")
        return run

    stage, moved = files._stage_contents, files._moved
    files._moved = once(moved, 1)
    done = files.write_files(df, stage=once(stage, 1)).collect()
    assert [r.status for r in done] == ["OK"] * 6, done
    assert sorted(os.listdir(f"{out}/o")) == [str(k) for k in range(6)]
    try:
        files.write_files(df, True, stage=once(lambda *a: stage(*a), 9))
        raise SystemExit("it must fail")
    except Exception as why:
        assert "lost after it wrote" in str(why), why
    assert sorted(os.listdir(f"{out}/o")) == [str(k) for k in range(6)]
    print("all well")
"""


def test_tasks_that_run_again(tmp_path):
    script = tmp_path / "failing.py"
    script.write_text(textwrap.dedent(FAILING))
    env = os.environ | {"PYTHONPATH": os.pathsep.join((str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")))}
    ran = subprocess.run([sys.executable, str(script), str(tmp_path)], env=env, capture_output=True, text=True, timeout=180)
    assert "all well" in ran.stdout, ran.stderr[-2000:]
