from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sieveworks.streaming.sessions import session_stream, sessions

SCHEMA = "id long, user string, `t.s` timestamp, text string, events string"
NAMES = ("id", "user", "t.s", "text")


def at(minutes: float) -> datetime:
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def brute(rows, gap):
    """Sorted rows of each key, a new session where more than gap lies between; the first row of an id counts."""
    once, out = {}, []
    for r in rows:
        if r[2] is not None:
            once.setdefault(r[0], r)
    for key in {r[1] for r in once.values()}:
        last = None
        for r in sorted((r for r in once.values() if r[1] == key), key=lambda r: r[2]):
            n = sum(c in "​⁠" for c in r[3] or "")
            if last is None or r[2] > last + gap:
                out.append([key, r[2], None, 0, 0])
            last = r[2]
            out[-1][2:] = [last + gap, out[-1][3] + 1, out[-1][4] + n]
    return sorted(map(tuple, out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_table_equals_brute_force(spark):
    rows = [(k, f"u{k % 3}" if k % 7 else None, at(k * 4 % 301), "a​" * (k % 4), "x") for k in range(90)]
    rows += [(500, "tie", at(0), "⁠", None), (501, "tie", at(10), None, None), (502, "tie", at(20.01), "", None), (503, "u1", None, "x", None)]
    df = spark.createDataFrame(rows + rows, SCHEMA)
    got = rows_of(sessions(df, *NAMES, "10 minutes", "1 hour"))
    assert got == brute(rows, timedelta(minutes=10))
    assert [r[3] for r in got if r[0] == "tie"] == [2, 1]  # just gap apart: one session
    assert sessions(df.limit(0), *NAMES, "10 minutes", "1 hour").count() == 0


def test_stream_drops_late_rows_and_goes_on_after_a_restart(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        session_stream(stream, *NAMES, out, state, late="30 minutes").awaitTermination()

    first = [(k, f"u{k % 2}", at(k), "a​b" * (k % 3), None) for k in range(20)]
    arrive(first)
    arrive([(0, "u0", at(0), "", None), (20, "u0", at(21), "​", None)])  # a copy, and a row that joins an open session
    arrive([(30, "u1", at(200), "far ahead", None)])
    arrive([(40, "u0", at(5), "​" * 9, None), (41, "u1", at(190), "not late", None)])  # the first is late
    arrive([(50, "end", at(1000), None, None)])
    arrive([(51, "end", at(2000), None, None)])
    on_time = [*first, (20, "u0", at(21), "​", None), (30, "u1", at(200), "", None), (41, "u1", at(190), "", None), (50, "end", at(1000), None, None)]
    assert rows_of(spark.read.parquet(out)) == brute(on_time, timedelta(minutes=10))
    twin = sessions(spark.createDataFrame(on_time, SCHEMA), *NAMES, "10 minutes", "30 minutes")
    assert rows_of(spark.read.parquet(out)) == rows_of(twin)
    assert spark.read.parquet(out).agg(F.sum("suspicious")).first()[0] == 20
