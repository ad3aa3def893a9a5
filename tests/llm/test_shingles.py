"""Groups of near copies: the prefix join against brute force, and how few pairs it proposes."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("sieveworks.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from sieveworks.llm import shingles, simhash  # noqa: E402


def edited(n: int, seed: int) -> list[str]:
    """Texts of one origin with 0 to 8 words changed, some cut short, and texts of their own."""
    rng = random.Random(seed)
    base, out = [f"w{k}" for k in range(120)], []
    for k in range(n):
        words = list(base)
        for e in range(rng.randrange(9)):
            words[rng.randrange(120)] = rng.choice(["same", f"own{k}x{e}"])
        out.append(" ".join(words[: rng.choice([120, 120, 110, 100])]))
    return out + [" ".join(rng.choice(base) for _ in range(60)) for _ in range(20)] + ["one two", "one two three"]


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_prefix_pairs_hold_every_similar_pair(spark, similarity):
    texts = edited(150, 3)
    sets = {shingles._node(s): s for s in (shingles.shingle_set(t, 5) for t in texts)}
    whole = {n: set(s.tolist()) for n, s in sets.items()}
    # every third set is of one component, whose own pairs are not wanted
    comp = {n: 0 if k % 3 == 0 else k for k, n in enumerate(whole)}
    opened = spark.createDataFrame([(n, len(s), comp[n]) for n, s in whole.items()], "node long, size long, comp long")
    held = spark.createDataFrame([(n, s.view("int64").tolist()) for n, s in sets.items()], "node long, hashes array<long>")
    got = {frozenset((r.node, r.node2)) for r in shingles.prefix_pairs(opened, held, similarity).collect()}
    pairs = {frozenset((a, b)) for a in whole for b in whole if a < b and comp[a] != comp[b]}
    similar = {p for p in pairs if jaccard(*(whole[n] for n in p)) >= similarity}
    assert similar and similar <= got <= pairs


@pytest.mark.parametrize("few", [0, 1 << 40])
def test_groups_of_edited_copies_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(shingles, "FEW", few)
    texts = edited(120, 5)
    sets = [set(shingles.shingle_set(t, 5).tolist()) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:  # smallest id reachable, by repeated passes
        new = [min([least[j] for j in range(len(texts)) if jaccard(sets[i], sets[j]) >= 0.8]) for i in range(len(texts))]
        if new == least:
            break
        least = new
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == dict(enumerate(least))


def test_heavily_edited_copies_are_not_compared_with_each_other(spark):
    """Copies with own words all over share bands at random, yet no pair of them is proposed; pairs with the origin aren't either."""
    base = [f"w{k}" for k in range(150)]
    rows = [[f"own{d}x{k}" if k % 25 == d % 25 else w for k, w in enumerate(base)] for d in range(400)]
    sets = {shingles._node(s): s for s in (shingles.shingle_set(" ".join(w), 5) for w in rows)}
    opened = spark.createDataFrame([(n, len(s)) for n, s in sets.items()], "node long, size long").withColumn("comp", F.col("node"))
    held = spark.createDataFrame([(n, s.view("int64").tolist()) for n, s in sets.items()], "node long, hashes array<long>")
    assert shingles.prefix_pairs(opened, held, 0.8).count() == 0


def test_simhash_keys_find_near_copies_without_bands(spark, monkeypatch):
    """With no band at all, keep_one drops copies within 4 bits through the Golay keys; the sets reject unlike texts of one print."""
    monkeypatch.setattr(shingles, "bands", lambda hashes: [])
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"v{k}" for k in range(300)), " ".join(base)]
    prints = [shingles.simhash_of(shingles.shingle_hashes(t, 5)) for t in texts]
    assert [p & (1 << 64) - 1 for p in prints] == [simhash.fingerprint(t, 5) for t in texts]
    assert 0 < ((prints[0] ^ prints[1]) & (1 << 64) - 1).bit_count() <= 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 2]
    assert sorted(r.doc_id for r in simhash.keep_one(docs, similarity=0.9999).collect()) == [0, 1, 2]
