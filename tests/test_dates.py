from __future__ import annotations

import datetime

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from sieveworks.operators import inspect
from sieveworks.plans import media


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_of_any_nanoseconds(spark, zone):
    rng = [0, 1, -1, 999_999_999, -999_999_999, 10**9 - 1, -(10**9) - 1, 2**63 - 1, -(2**63), *(k * 10**9 - 1 for k in (10**9, 2**32, 4_293_918_720, 9 * 10**9)), (24 * 365 - 100) * 86_400 * 10**9]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark.createDataFrame([(n,) for n in [*rng, None]], "ns long").select("ns", inspect.ebml_date(F.col("ns")).alias("iso")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    for ns, iso in got:
        seconds = None if ns is None else abs(ns) // 10**9 * (1 if ns > 0 else -1)
        assert iso == (None if ns is None else (datetime.datetime(2001, 1, 1) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ"))


def test_query_beyond_a_long(spark, tmp_path):
    ids = [0, 11, 12, 49_711, 106_764, 106_765, 106_766, 256_409, 2_400_000, 2_921_000, 9_000_000, -9, -1_000_000, None]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert compare(spark, str(tmp_path), media.mkv_date_iso, media.ORACLE_SQL["mkv_date_iso"], connect(tmp_path)) is None
