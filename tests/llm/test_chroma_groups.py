"""Near copies in chroma alignment: results equal the plain join of keys, whose rows grow with their number squared."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("sieveworks.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from sieveworks.llm import chroma  # noqa: E402


def group(rng, n: int, first: int, change: int) -> list[tuple[int, list[int]]]:
    """Recordings of 50 integers of which each has `change` runs of 4 with a tenth of their bits wrong; some begin later."""
    base, rows = rng.integers(0, 1 << 32, 50, dtype=np.uint64), []
    for k in range(n):
        fp = base.copy()
        for at in rng.integers(0, 46, change):
            fp[at : at + 4] ^= ((rng.random((4, 32)) < 0.1) * (1 << np.arange(32, dtype=np.uint64))).sum(axis=1).astype(np.uint64)
        rows.append((first + k, fp[k % 3 :].astype(np.int64).tolist()))
    return rows


def rows_by_key(spark, since: int) -> int:
    """Rows that joins on the key alone have made in the executions from number `since` on."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    for i in range(since, store.executionsCount()):
        execution = store.executionsList().apply(i)
        values, nodes = store.executionMetrics(execution.executionId()), store.planGraph(execution.executionId()).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if "Join" in node.name() and "[key#" in node.desc():
                metrics = [node.metrics().apply(m) for m in range(node.metrics().size())]
                made += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return made


def test_groups_of_near_copies_align_as_pair_by_pair(spark):
    rng = np.random.default_rng(4)
    rows = [*group(rng, 150, 0, 3), *group(rng, 30, 200, 6), *((300 + k, v) for k, v in enumerate(rng.integers(0, 1 << 32, (40, 50)).tolist()))]
    rows += [(400, rows[7][1]), (401, rows[7][1][:9]), (402, [5] * 40), (403, [])]
    prints = spark.createDataFrame(rows, "rec_id long, fp array<long>")
    queries = prints.filter("rec_id % 10 = 0 or rec_id > 399")
    masks = chroma.key_masks(chroma.POSITIONS)

    def plain(step, which):
        q = chroma.keys(queries, masks, step).toDF("query_id", "q", "key")
        hits = q.join(chroma.keys(prints, masks, step), "key").filter("query_id != rec_id").filter(which)
        return hits.groupBy("query_id", "rec_id", (F.col("pos") - F.col("q")).alias("o")).count().filter("count > 2").collect()

    want: dict[tuple[int, int], tuple[int, int]] = {}
    for r in plain(chroma.WIDTH, "true") + plain(1, "query_id = 401 or rec_id = 401"):
        want[r.query_id, r.rec_id] = max(want.get((r.query_id, r.rec_id), (0, 0)), (r["count"], -r.o))
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {(r.query_id, r.rec_id): (r.votes, -r.offset) for r in chroma.align(prints, queries, most_errors=1.0).collect()}
    assert len(want) > 2500 and got == want
    made = rows_by_key(spark, since)
    assert 0 < made < 30 * len(want)
