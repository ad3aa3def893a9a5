from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from sieveworks.operators.ranges import overlap_join


def test_overlap_join(spark):
    rng = random.Random(1)

    def some(n, kind):
        rows = []
        for k in range(n):
            a = rng.randrange(2000)
            rows.append((rng.choice(["x", "y", None]), a, a + rng.choice([0, 1, 2, 3, 7, 64, 65, 500, 1 << 40]), f"{kind}{k}"))
        return [*rows, (None, None, 5, f"{kind}n"), ("x", 0, 1, f"{kind}e"), ("x", 0, 1, f"{kind}e")]

    left, right = some(120, "l"), some(130, "r")
    schema = "key string, start long, stop long, `name.x` string"
    got = overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["key"]).select("key", F.col("l")["name.x"], F.col("r")["name.x"]).collect()
    want = Counter((a[0], a[3], b[3]) for a in left for b in right if a[0] == b[0] and None not in (a[1], b[1]) and max(a[1], b[1]) < min(a[2], b[2]))
    assert Counter(map(tuple, got)) == want and len(want) > 500
    none = spark.createDataFrame([], schema)
    assert overlap_join(none, spark.createDataFrame(right, schema), ["key"]).collect() == []
