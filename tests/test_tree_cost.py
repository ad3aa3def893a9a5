from __future__ import annotations

import json

import pytest
from media import box
from pyspark.sql import functions as F

from sieveworks.operators import inspect
from sieveworks.plans import trees
from sieveworks.sources import files

LONG = "x" * 50_000 + "\x00 "


def plan_of(df, part):
    return df._jdf.queryExecution().executedPlan().toString().count(part)


@pytest.fixture
def saves(monkeypatch):
    """What is saved, by name."""
    made = {}
    keep = inspect.saved
    monkeypatch.setattr(inspect, "saved", lambda df, name: made.setdefault(name, df) and keep(df, name))
    return made


@pytest.mark.parametrize("query", [trees.mkv_tree, trees.mp4_tree, trees.png_tree, trees.raw_tree])
def test_files_cross_into_python_once(spark, sf_dir, saves, query):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    found = query(spark, sf_dir)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == files.BATCH_BYTES <= 8 << 20
    assert len(saves) == 1 and plan_of(*saves.values(), "ArrowEvalPython") == 1
    assert found.count() == 200


def test_a_tree_takes_one_shuffle_beside_what_is_cleaned(spark, sf_dir):
    assert plan_of(trees.raw_tree(spark, sf_dir), "Exchange ") <= 3


def test_values_come_back_as_they_are_shown(spark):
    """Only the bytes that are shown leave Python, but what is said of them is said of all."""
    mostly = b"a" * 300 + b"\1" * 5000
    made = [("long", box(b"udta", LONG.encode())), ("mostly", box(b"udta", mostly))]
    content = [(k, "mp4", bytearray(box(b"ftyp", b"isom\0\0\2\0") + box(b"moov", b) + box(b"mdat", b"f"))) for k, b in made]
    df = spark.createDataFrame(content, "file string, format string, content binary")
    held = df.select(F.explode(inspect.scan_parsed("format", "content")["fields"]).alias("f")).select("f.*").collect()
    assert {len(r.raw) for r in held} == {inspect.LONGEST} and {r.length for r in held} == {50_002, 5300} and {r.trimmed for r in held} == {50_000, 5300}
    got = {r.file: json.loads(r.m)["boxes"][0] for r in inspect.trees(df, "file").select("file", F.to_json("metadata").alias("m")).collect()}
    assert got["long"] == {"type": "udta", "size": 50_010, "text": "x" * inspect.PREVIEW} and got["mostly"]["text"] is None


def test_many_fields_go_in_pieces(spark):
    names = [box(b"aaaa", str(k).encode()) for k in range(3000)]
    content = box(b"ftyp", b"isom\0\0\2\0") + box(b"moov", box(b"udta", *names)) + box(b"mdat", b"f")
    df = spark.range(5).select("id", F.lit("mp4").alias("format"), F.lit(bytearray(content)).alias("content")).coalesce(1)
    for r in inspect.trees(df, "id").select(F.to_json("metadata").alias("m")).collect():
        kids = json.loads(r.m)["boxes"][0]["children"]
        assert [x["text"] for x in kids] == [str(k) for k in range(3000)]
