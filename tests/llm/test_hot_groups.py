"""Groups of equal pieces in packing, and large buckets of fingerprints."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("sieveworks.llm.queries")

from sieveworks.llm import packing, simhash, substring  # noqa: E402


def test_many_equal_pieces_take_little_time():
    idf = np.ones(1 << 16)
    for pieces in ([np.array([2])] * 20_000, [np.array([k % 2000, 2]) for k in range(40_000)]):
        began = time.time()
        done = packing.fill(pieces, 4096, idf, 2.0)
        assert time.time() - began < 20
        assert sorted((k, a, b) for s in done for k, a, b in s if b - a == len(pieces[k])) and sum(b - a for s in done for _, a, b in s) == sum(map(len, pieces))
        assert all(sum(b - a for _, a, b in s) == 4096 for s in done[:-13])


def test_equal_pieces_keep_apart_while_others_are_left():
    rng = np.random.default_rng(1)
    pieces = [rng.integers(3, 500, 50) for _ in range(100)]
    pieces += [pieces[k] for k in range(50)] * 2
    done = packing.fill(pieces, 500, np.ones(1 << 16), 50.0)
    same = [p.tobytes() for p in pieces]
    mixed = [len({same[k] for k, _, _ in s}) == len(s) for s in done]
    assert all(mixed[:12])  # later there are fewer groups left than a window holds pieces
    covered = np.zeros((200, 50), int)
    for s in done:
        for k, a, b in s:
            covered[k, a:b] += 1
    assert (covered == 1).all()


@pytest.mark.parametrize("exact", [1, 2, 3])
def test_finer_keys_split_a_bucket_and_lose_no_link(exact):
    rng = np.random.default_rng(exact)
    errors, n = 4, 20_000
    first = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    key = int(next(iter(simhash.bucket_keys(first, errors, exact)))[0, 0])
    free = simhash.free_bits(key, errors, exact)
    assert 15 <= len(free) <= 30
    fp = np.repeat(first, n)
    for b in free:
        fp ^= rng.integers(0, 2, n, dtype=np.uint64) << np.uint64(b)
    assert all(key in row for row in next(iter(simhash.bucket_keys(fp[:50], errors, exact))))  # free bits don't change the key
    found = simhash._finer(key, fp.view(np.int64), errors, exact)
    assert found.groupby("key").size().max() < n / 8
    one, keys = fp[0], {}
    for k, f in zip(found["key"], found["a"], strict=True):
        keys.setdefault(f, set()).add(k)
    for _ in range(200):
        other = one
        for b in rng.choice(free, errors, replace=False):
            other ^= np.uint64(1) << np.uint64(b)
        more = set(simhash._finer(key, np.array([other]).view(np.int64), errors, exact)["key"])
        assert more & keys[one.view(np.int64)]


def test_dotted_columns(spark):
    df = spark.createDataFrame([(1, "One two three. " * 30, "x"), (2, "One two three. " * 30, "y")], "doc_id long, text string, `a.b` string")
    assert {r["a.b"] for r in substring.dedup(df).collect()} == {"x", "y"}
    assert [r["a.b"] for r in simhash.keep_one(df).collect()] == ["x"]
