from __future__ import annotations

from sieveworks.operators.ranges import overlap_join


def test_dealt_sides_are_never_broadcast(spark, tmp_path):
    """A table far below the limit of a broadcast is many times as large once its rows are dealt to the levels."""
    rows = [(k, 0, 1 << k % 40) for k in range(400)]
    spark.createDataFrame(rows, "key long, start long, stop long").write.parquet(f"{tmp_path}/ranges")
    ranges = spark.read.parquet(f"{tmp_path}/ranges")
    met = overlap_join(ranges, ranges, ["key"])
    assert met.count() == 400
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
