"""Connected components: results against union-find, and how few jobs the driver runs for them."""

from __future__ import annotations

import random
import uuid

import pytest

pytest.importorskip("sieveworks.llm.queries")

from sieveworks.llm.common import components  # noqa: E402


def brute(edges: list[tuple[int | None, int | None]]) -> dict[int, int]:
    label = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("kind", ["path", "random", "stars", "two hubs"])
def test_components_equal_union_find(spark, kind):
    rng = random.Random(3)
    edges = {
        "path": [(k, k + 1) for k in range(60)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "stars": [(k, k // 40 * 40) for k in range(200) if k % 40],
        "two hubs": [(100 + k, k % 2) for k in range(80)] + [(150, 0), (150, 1)],
    }[kind]
    rows = [*edges, *((b, a) for a, b in edges[:20])]
    got = components(spark.createDataFrame([*rows, (None, 3), (4, None)], "a long, b long").repartition(4)).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == brute(rows)


def test_no_edge_gives_no_row(spark):
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).isEmpty()


def test_edges_that_are_stars_take_no_step(spark):
    """A step that only confirms the last one is ten jobs or so for the driver."""
    edges = spark.createDataFrame([(k, k // 100 * 100) for k in range(2000)], "a long, b long").repartition(4, "a")
    group, context = uuid.uuid4().hex, spark.sparkContext
    context.setJobGroup(group, "components")
    try:
        n = components(edges).count()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert n == 2000 and 0 < len(context.statusTracker().getJobIdsForGroup(group)) <= 12
