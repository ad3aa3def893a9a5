"""What a Python worker still holds when a stage's tasks are over, and how much at most before."""

from __future__ import annotations

import gc
import tracemalloc

import pandas as pd
import pytest

pytest.importorskip("sieveworks.llm.queries")

from sieveworks.llm import packing  # noqa: E402
from sieveworks.llm.queries import tokenizer_path  # noqa: E402

PATH = "word_bpe_49k.json"


def entries_in_workers(spark):
    """The entries of all caches of ids that are alive in each of some Python workers."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [sum(len(x) + len(x.old) for x in gc.get_objects() if type(x).__name__ == "Generations")] * len(pdf)})

    return [r.n for r in spark.range(0, 8, 1, 8).mapInPandas(run, "n long").collect()]


def test_cached_ids_go_when_the_worker_does_something_else(spark):
    docs = spark.range(0, 2000, 1, 8).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 20), x -> concat('w', id * 20 + x))) text")
    assert packing.token_pieces(docs, tokenizer_path(PATH), 4096).agg({"doc_tokens": "sum"}).first()[0] > 40_000
    assert entries_in_workers(spark) == [0] * 8


def test_tasks_of_a_worker_share_one_cache():
    cached = packing.Cached(tokenizer_path(PATH))
    assert cached.word_ids() is cached.word_ids()


def test_a_full_cache_is_bounded():
    runs = packing.Generations(lambda run: run[:6].encode())
    tracemalloc.start()
    for k in range(1_300_000):
        runs[f"{k:010d}"]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 110e6, f"{peak / 1e6:.0f} MB"


def test_ids_of_runs_are_those_of_the_library():
    words = packing.WordIds(packing.load(tokenizer_path(PATH)))
    for run in ("the", "The", "stra\u00dfe", "\u0130stanbul", "\u00c9t\u00e9", "na\u00efve", "abc123", "end.", "\u00aa", "\u03a3\u03af", "x" * 300, ""):
        assert words.run(run) == words.whole(run), run
