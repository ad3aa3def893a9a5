from __future__ import annotations

from test_inspect import FILES

from sieveworks.functions import sql
from sieveworks.operators import inspect, strip


def test_lateral(spark):
    sql.register(spark)
    df = spark.createDataFrame([(k, v[0], bytearray(v[1])) for k, v in FILES.items()] + [("none", "png", None), ("other", "pdf", bytearray(b"x"))], "file string, format string, content binary")
    df.createOrReplaceTempView("some_files")
    got = spark.sql("select f.file, c.* from some_files f, lateral chunks_of(f.format, f.content) c").collect()
    want = {(r.file, r.seq, r.id, r.role, r.size, r.start, r.body, r.stop) for r in strip.with_error(df).filter("error is null").selectExpr("file", "posexplode(scanned) as (seq, u)").select("file", "seq", "u.*").drop("zones").collect()}
    assert {tuple(r)[:-1] for r in got if r.error is None and r.file != "bad"} == want
    assert [r.error is not None for r in got if r.file == "bad"] == [True] and not [r for r in got if r.file in ("none", "other")]
    shown = spark.sql("select f.file, c.seq, c.section, c.size, c.parent from some_files f, lateral fields_of(f.format, f.content) c").collect()
    fields = {(r.file, r.seq, r.section, r.size) for r in inspect.fields(df, "file").collect()}
    assert {tuple(r)[:4] for r in shown if r.file != "bad"} == fields
    assert {r.parent for r in shown if r.file == "mp4" and r.section == "boxes"} == {-1, 1, 2, 3, 4}
