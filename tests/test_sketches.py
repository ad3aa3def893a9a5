from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    """Source a holds most rows; b has values of its own and some of a's; a null source and a source of null values."""
    many = spark.range(60_000).select(F.lit("a").alias("source"), F.lit("png").alias("kind"), (F.col("id") % 20_000).cast("string").alias("value"))
    other = spark.range(9000).select(F.lit("b").alias("source"), F.lit("wav").alias("kind"), (F.col("id") + 15_000).cast("string").alias("value"))
    odd = spark.createDataFrame([(None, "png", "x"), (None, "png", "x"), ("n", "wav", None), ("e", "wav", "")], "source string, kind string, value string")
    return many.union(other).union(odd)


def exact(rows, by):
    return {tuple(r)[:-2]: (r.n, r.d) for r in rows.groupBy(*by).agg(F.count("value").alias("n"), F.count_distinct("value").alias("d")).collect()}


def near(got, n):
    return abs(got - n) <= max(1, n * sketches.most_error())


def test_parts_merge_to_the_whole(rows):
    parts = [sketches.sketch(rows.filter(F.coalesce(F.crc32("value"), F.lit(0)) % 3 == k), ["source", "kind"], "value") for k in range(3)]
    merged = sketches.merge(parts[0].union(parts[1]).union(parts[2]), ["source", "kind"]).withColumn("d", sketches.estimate())
    got, want = {(r.source, r.kind): (r.rows, r.d) for r in merged.collect()}, exact(rows, ["source", "kind"])
    assert got.keys() == want.keys()
    for key, (n, d) in want.items():
        assert got[key][0] == n and near(got[key][1], d)
    assert got["n", "wav"] == (0, 0) and got[None, "png"] == (2, 1)


def test_cube_tells_null_keys_from_columns_left_out(rows):
    by, sets = ["kind", "source"], [["kind", "source"], ["kind"], ["source"], []]
    made = sketches.cube(sketches.sketch(rows, by, "value"), sets, by).withColumn("d", sketches.estimate()).collect()
    got = {(r.level, r.kind, r.source): (r.rows, r.d) for r in made}
    assert len(made) == len(got)
    for level, names in ((0, by), (1, ["kind"]), (2, ["source"]), (3, [])):
        for key, (n, d) in exact(rows, names).items():
            named = dict(zip(names, key, strict=True))
            have = got.pop((level, named.get("kind"), named.get("source")))
            assert have[0] == n and near(have[1], d)
    assert not got


def test_overlaps_count_once(rows):
    whole = sketches.merge(sketches.sketch(rows, ["source"], "value"), []).select(sketches.estimate().alias("d")).first()
    assert near(whole.d, 24_002)  # 20,000 of a, 4,000 of b alone, "x" and ""


def test_empty_and_clashing_names(spark, rows):
    none = rows.limit(0)
    assert sketches.sketch(none, ["source"], "value").count() == 0
    assert sketches.merge(sketches.sketch(none, ["source"], "value"), ["source"]).count() == 0
    dotted = spark.createDataFrame([("p", "v"), ("p", "w")], "`a.b` string, `sketch` string")
    assert sketches.sketch(dotted, ["a.b"], "sketch").select("`a.b`", sketches.estimate()).collect() == [("p", 2)]
    for wrong in (["sketch"], ["source", "source"]):
        with pytest.raises(ValueError):
            sketches.sketch(rows.withColumnRenamed("kind", "sketch"), wrong, "value")
    with pytest.raises(ValueError):
        sketches.cube(rows, [["kind"]], ["source"])
