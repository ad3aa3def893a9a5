from __future__ import annotations

import media
import pytest
from media import chunk, riff
from pyspark.sql import functions as F

from sieveworks.__main__ import main
from sieveworks.functions import sql
from sieveworks.operators import batch
from sieveworks.sources import files, formats
from sieveworks.streaming.files import clean_stream, strip_stream

WAV = riff(b"WAVE", chunk(b"fmt ", bytes(16)), chunk(b"LIST", b"INFO"), chunk(b"data", b"s!"))


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    (source / "deeper").mkdir(parents=True)
    (source / "a.wav").write_bytes(WAV)
    (source / "b.PNG").write_bytes(b"\x89PNG\r\n\x1a\nbad")
    (source / "c.txt").write_text("a\u200bb\u00a0c", encoding="utf8")
    (source / "d.md").write_bytes(b"\xff\xfe\x00")
    (source / "e.pdf").write_bytes(b"%PDF")
    (source / "deeper" / "f.gif").write_bytes(media.gif(media.GIF_IMAGE))
    return source


def test_formats(spark):
    paths = ["x/a.JPG", "b.tar.heif", "c.nef", "noext", "d.pdf", "e.yml", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = df.select(formats.format_of(F.col("path")), formats.is_text_path(F.col("path"))).collect()
    assert [tuple(r) for r in rows] == [("jpeg", False), ("heic", False), ("raw", False), (None, False), (None, False), ("text", True), (None, False)]
    assert formats.extension_table(spark).count() == 39


def test_out_paths(spark):
    df = spark.createDataFrame([("x/a.JPG",)], "path string")
    row = df.select(formats.out_path(F.col("path"), F.lit("o/")).alias("a"), formats.out_path(F.col("path"), F.lit("o/z.jpg"), True).alias("b"), formats.out_path(F.col("path"), F.lit("o/z.jpg")).alias("c")).first()
    assert tuple(row) == ("o/a.JPG", "o/z.jpg", "o/z.jpg/a.JPG")


def test_listing_and_batch(spark, folder, tmp_path):
    listed = files.inputs(spark, str(folder))
    assert [(r.path.rpartition("/")[2], r.format) for r in listed.collect()] == [("a.wav", "wav"), ("b.PNG", "png"), ("c.txt", "text"), ("d.md", "text")]
    assert files.inputs(spark, str(folder), recursive=True).count() == 5
    found = files.read_files(spark, str(folder))
    assert "content" not in files.inputs(spark, str(folder)).columns
    out = tmp_path / "out"
    dry = {r.path.rpartition("/")[2]: r.status for r in batch.process(found, f"file://{out}", dry_run=True).collect()}
    assert dry == {"a.wav": "DRY", "b.PNG": "FAIL", "c.txt": "DRY", "d.md": "FAIL"} and not out.exists()
    done = batch.process(found, f"file://{out}").collect()
    assert sorted(r.status for r in done) == ["FAIL", "FAIL", "OK", "OK"]
    assert (out / "c.txt").read_text(encoding="utf8") == "ab c" and (out / "a.wav").read_bytes() == riff(b"WAVE", chunk(b"fmt ", bytes(16)), chunk(b"data", b"s!"))
    assert sorted(p.name for p in out.iterdir()) == ["a.wav", "c.txt"]
    again = batch.process(found, f"file://{out}")
    assert tuple(batch.totals(again).first()) == (2, 2, 2)
    assert files.without_existing(found, files.inputs(spark, str(out))).count() == 2
    forced = batch.strip_files(found, force_text=True).filter("error is null").count()
    assert forced == 3


def test_streams(spark, folder, tmp_path):
    out, log = tmp_path / "out", tmp_path / "log"
    strip_stream(spark, str(folder), f"file://{out}", str(log), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.status for r in spark.read.parquet(str(log)).collect()) == ["FAIL", "FAIL", "OK", "OK"]
    spark.createDataFrame([(1, "a\u200bb"), (2, None)], "id long, text string").write.parquet(str(tmp_path / "texts"))
    texts = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "texts"))
    clean_stream(texts, "id", "text", str(tmp_path / "clean"), str(tmp_path / "cp2")).awaitTermination()
    assert {(r.id, r.clean) for r in spark.read.parquet(str(tmp_path / "clean")).collect()} == {(1, "ab"), (2, None)}


def test_command_line(spark, folder, tmp_path, capsys):
    assert main([str(folder), "--out", f"file://{tmp_path}/o", "--verbose"], spark) == 2
    assert "done: 2 ok, 2 failed" in capsys.readouterr().out
    assert main([str(folder / "a.wav"), "--out", f"file://{tmp_path}/o2/new.wav"], spark) == 0
    assert (tmp_path / "o2" / "new.wav").exists()
    assert main([str(folder / "c.txt"), "--inspect"], spark) == 0
    assert '"zwj_family"' in capsys.readouterr().out.replace("\\", "")
    with pytest.raises(SystemExit) as stopped:
        main([str(folder / "missing"), "--out", "x"], spark)
    assert stopped.value.code == 1


def test_sql_names(spark):
    sql.register(spark)
    row = spark.sql("select size(scan_units('png', unhex('89504E470D0A1A0A')).units) n, (select count(*) from strip_policy where format = 'wav') p").first()
    assert row.n == 0 and row.p == 6
