"""The distinct ids of pieces and their two largest, all pieces at once."""

from __future__ import annotations

import time

import numpy as np
import pytest

pytest.importorskip("sieveworks.llm.queries")

from sieveworks.llm import packing  # noqa: E402


def test_distinct_ids_and_largest_equal_those_of_each_piece():
    rng = np.random.default_rng(8)
    pieces = [rng.integers(0, 1 << 16, n).astype("<u2") for n in (1, 2, 700, 5, 70_000)] + [np.array([2], "<u2"), np.array([65535] * 3, "<u2")]
    doc, term, tf = packing.distinct(pieces)
    top, below = packing.two_largest(np.concatenate(pieces), np.array([len(p) for p in pieces]))
    for k, p in enumerate(pieces):
        ids, n = np.unique(p, return_counts=True)
        assert term[doc == k].tolist() == ids.tolist() and tf[doc == k].tolist() == n.tolist()
        assert top[k] == ids[-1] and below[k] == (ids[-2] if len(ids) > 1 else 0)
    assert [len(x) for x in packing.distinct([])] == [0, 0, 0] and len(packing.two_largest(np.empty(0, "<u2"), np.empty(0, np.int64))[0]) == 0


def test_distinct_ids_take_less_than_a_count_of_the_vocabulary_for_each_piece():
    rng = np.random.default_rng(9)
    pieces = [rng.integers(0, 49_000, 200).astype("<u2") for _ in range(500)]

    def best(f):
        times = []
        for _ in range(5):
            began = time.perf_counter()
            f()
            times.append(time.perf_counter() - began)
        return min(times)

    assert best(lambda: packing.distinct(pieces)) < best(lambda: [np.flatnonzero(np.bincount(p)) for p in pieces])
