"""The pipeline's stages on a small table with planted cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran sel tim von".split()]
COPIES, NEAR = (900, 901), (902,)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if k % 9 == 8 else "") for k in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        extra = [rng.choice(["vilescum", "hatefool", "trashidiot"]) for _ in range(8)] if toxic else []
        rows.append((k, prose(rng, 80) + " " + " ".join(extra), "en", f"s{k % 3}", 0))
        labels += [(k, 1, int(toxic))]
    shared = prose(rng, 60)
    rows += [(i, rows[1][1], "en", "s1", 0) for i in COPIES] + [(899, long := prose(rng, 1500), "en", "s1", 0), (NEAR[0], long.replace(" ", " x ", 1), "en", "s1", 0)]
    rows += [(910, prose(rng, 40) + ".\n" + shared + ".\n" + prose(rng, 40), "en", "s1", 0), (911, prose(rng, 40) + ".\n" + shared + ".\n" + prose(rng, 40), "en", "s1", 0)]
    rows += [(920, None, None, None, None), (921, "", "en", None, 0), (None, "no id here", "en", "s0", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, shared


def test_stages(spark, corpus, tmp_path):
    folder, shared = corpus
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = after[name] = spark.read.parquet(f"{tmp_path}/{k}")
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in after.items()}
    toxic = {k for k in range(400) if k % 4 == 0}
    assert not toxic & set(ids["toxicity"]) and set(range(400)) - toxic <= set(ids["toxicity"])
    assert not {*COPIES, *NEAR} & set(ids["simhash"]) and set(range(400)) - toxic <= set(ids["simhash"])
    texts = {r.doc_id: r.text for r in after["substring"].collect()}
    assert shared[:200] in texts[910] and shared[:200] not in texts[911] and texts[920] is None
    assert sorted(ids["substring"], key=str) == sorted(ids["simhash"], key=str)
    assert max(ids["mixing"].count(i) for i in set(ids["mixing"])) <= 2
    tokens = after["packing"].groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("copies"))
    assert tokens.filter("n != doc_tokens * copies").isEmpty() and after["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()


def test_run_equals_its_stages(spark, corpus):
    assert {r.doc_id for r in pipeline.run(spark, corpus[0]).select("doc_id").collect()} <= set(range(400)) | {899, 910, 911, 920, 921, None}
