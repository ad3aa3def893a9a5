"""Whitening, the Merkle manifest and line dedup, each against a plain version of itself."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sieveworks.llm.queries")

from sieveworks.llm import lines, merkle, queries, whiten  # noqa: E402

# ---- 11: whitening


def plain_whitening(vectors, components=4):
    x = np.floor(256 * np.array(vectors, dtype=float)).astype(np.int64)
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(axis=0)
    off = listed - sums / n
    values, rows = np.linalg.eigh(off.T @ off / n)
    values, rows = values[::-1], rows[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ rows[:, :components] / np.sqrt(values[:components]), values / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.1]).tolist()
    vectors += [vectors[0]] * 80  # a hot vector counts once
    rows = [(k, v, k % 3, "x") for k, v in enumerate(vectors)]
    rows += [(None, vectors[1], 1, None), (7, vectors[7], 1, "again")]
    rows += [(1000, None, 0, "x"), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, "x"), (1002, [float("nan")] * 6, 0, "x"), (1003, [float("inf")] + [0.0] * 5, 0, "x"), (1004, [], 0, "x"), (1005, [1.0, 2.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, `a.b` string").repartition(5)
    got = whiten.whiten(df).collect()
    assert len(got) == len(vectors) + 2 and {r.vec_id for r in got}.isdisjoint(range(1000, 1006)) and "a.b" in got[0].asDict()
    asc = [np.float32(v).astype(float) for v in vectors]
    n, deviation, white, explained = plain_whitening(asc)
    by = {r.vec_id: r for r in got if r.vec_id is not None}
    signs = np.sign(np.array(by[0].whitened) * white[0])
    for k in range(len(vectors)):
        r = by[k]
        assert (r.n, r.deviation) == (n, deviation[k])
        assert np.allclose(np.array(r.whitened) * signs, white[k], atol=1e-9)
        assert np.allclose(r.explained, explained[:4], rtol=1e-9) and r.identity_error < 1e-9
    null = next(r for r in got if r.vec_id is None)
    assert null.whitened == by[1].whitened


def test_whitening_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whiten.whiten(none).collect() == []
    assert whiten.whiten(spark.createDataFrame([(1, None), (2, [None])], "vec_id long, embedding array<float>")).collect() == []
    equal = whiten.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in equal] == [(1, 0, [], None)] * 2
    line = whiten.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(4)], "vec_id long, embedding array<double>")).collect()
    assert all(len(r.whitened) == 1 for r in line) and abs(line[0].explained[0] - 1) < 1e-12
    far = whiten.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, -0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in far} == {1: None, 2: None, 3: 512**2 + 1}


def test_moments_merge_in_any_parts(spark):
    rng = np.random.default_rng(4)
    data = rng.integers(-300, 300, (500, 5)) + 10**6  # a large mean, where sums of squares would cancel
    df = spark.createDataFrame([(x,) for x in data.tolist()], "x array<long>")
    want = np.cov(data.T, bias=True)
    for parts in (1, 3, 40):  # 40 states take two rounds of merging
        got = whiten.moments(df.repartition(parts), 5)
        assert got.n == 500 and got.exact == data.sum(axis=0).tolist() and np.allclose(got.covariance(), want, rtol=1e-10)


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_eigen(size):
    rng = np.random.default_rng(size)
    for matrix in (np.cov(rng.normal(size=(size, 3 * size + 2))).reshape(size, size), np.eye(size), np.zeros((size, size)), np.ones((size, size))):
        values, rows = whiten.eigen(matrix)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], atol=1e-12) and np.allclose(rows @ rows.T, np.eye(size), atol=1e-12)
        assert np.allclose(rows @ matrix, values[:, None] * rows, atol=1e-12)


# ---- 12: the Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Of (doc_id, source, lang, n_chars, text): the leaf, subroot, root, proof and check of each, in the rows' order."""

    def leaf(*values):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def build(nodes):
        """Root, and for each node its siblings as (left, right) by level."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, i in enumerate(at):
                run = level[i // 8 * 8 : i // 8 * 8 + 8]
                paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            at = [i // 8 for i in at]
            level = [sha(*level[k : k + 8]) for k in range(0, len(level), 8)]
        return level[0], paths

    trees = defaultdict(list)
    for k, r in enumerate(rows):
        trees[r[2]].append((r[0] is not None, r[0], leaf(*r), k))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: build([y[2] for y in sorted(trees[x], key=lambda y: (y[0], y[1] or 0, y[2]))]) for x in langs}
    root, above = build([built[x][0] for x in langs])
    out = {}
    for x, path in zip(langs, above, strict=True):
        for y, own in zip(sorted(trees[x], key=lambda y: (y[0], y[1] or 0, y[2])), built[x][1], strict=True):
            doc_id, source, lang, n_chars, text = rows[y[3]]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = text.translate({k: k + 32 for k in range(65, 91)})
            node = leaf(doc_id, source, lang, n_chars, text)
            for left, right in own + path:
                node = sha(left, node, right)
            out[y[3]] = (y[2], built[x][0], root, sha(*(a + b for a, b in own + path)), node, node == root)
    return [out[k] for k in range(len(rows))]


LEAF_SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
WORDS = "The river Stone walks NEVER quietly Éclair naïve 中".split()


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randrange(1, 9))) for _ in range(n)]


def digests(df):
    return merkle.manifest(df, changed=merkle.tampered(F.col("text"), F.col("doc_id")))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9, 1], [100, 65, 2, 64, 1, 3, 7, 8, 9, 5], [600]])
def test_manifest(spark, sizes):
    langs = [None, "de", "en", "ét", "z\U0001f600", "�", "a", "b", "c", ""]
    rows, t = [], iter(texts(sum(sizes)))
    for lang, n in zip(langs, sizes, strict=False):
        rows += [(len(rows) * 3 + k, "web" if k % 2 else None, lang, k or None, next(t) if k % 7 else (None if k % 2 else "")) for k in range(n)]
    random.Random(2).shuffle(rows)
    want = {r[0]: x for r, x in zip(rows, plain_manifest(rows), strict=True)}
    got = digests(spark.createDataFrame(rows, LEAF_SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == want[r.doc_id]
    assert sum(sizes) < 8 or {r.verified for r in got} == {True, False}


def test_manifest_of_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "web", "en", 3, "ABC")] * 30 + [(5, "web", "en", 3, "abd"), (6, "w", "en", 1, "Q" * 300_000)]
    want = sorted(plain_manifest(rows))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], LEAF_SCHEMA + ", leaf int, `idx.n` string")
    got = digests(df).collect()
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == want
    assert got[0]["idx.n"] == "x" and got[0].n_chars in (None, 3, 1)
    empty = digests(spark.createDataFrame([], LEAF_SCHEMA))
    assert empty.collect() == [] and empty.columns[:2] == ["doc_id", "lang"]


# ---- 13: line dedup


def plain_lines(rows, length=20, least=3):
    space = " \t\n\x0b\x0c\r"

    def key(line):
        return line.strip(space).translate({k: k + 32 for k in range(65, 91)})

    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= length:
                held[key(line)].add(doc_id)
    top = {k: max(v, key=lambda x: (x is not None, x or 0)) for k, v in held.items() if len(v) >= least}
    out = []
    for doc_id, text in rows:
        cut = (text or "").split("\n")
        stay = [x for x in cut if key(x) not in top or top[key(x)] == doc_id]
        out.append((doc_id, len(cut), len(cut) - len(stay), "\n".join(stay)))
    return out


def test_lines(spark):
    rng, common = random.Random(3), [f"Line number {k} that many documents hold" for k in range(12)]
    rows = []
    for k in range(120):
        own = [rng.choice([x := rng.choice(common), f"  {x.upper()}\t", x + "\r", "short", "", "É" * 19, "É" * 20, f"alone {k} {rng.random()} in the table"]) for _ in range(rng.randrange(9))]
        rows.append((k, "\n".join(own)))
    rows += [(3, rows[5][1]), (4, rows[4][1]), (4, rows[4][1]), (None, rows[6][1]), (None, rows[7][1]), (200, None), (201, ""), (202, "\n"), (203, "\n\n" + common[0] + "\n" + common[0])]
    rows += [(k, "The line of a third of all documents.") for k in range(300, 360)]
    rows += [(400, "\n".join([*common, "x"] * 4000)), (-5, "\n".join(common))]
    df = spark.createDataFrame([(*r, "y", 2) for r in rows], "doc_id long, text string, `kept.x` string, n_lines int").repartition(4)
    got = lines.dedup(df).collect()
    want = plain_lines(rows)
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept) for r in got) == sorted((a or -1, b, c, d) for a, b, c, d in want)
    assert {(r.doc_id, r.text) for r in got} == set(rows) and got[0]["kept.x"] == "y"
    assert sum(r.n_dropped for r in got) > 200
    assert lines.dedup(df.limit(0)).collect() == []


def test_line_positions_take_linear_time(spark):
    many = "\n".join(f"a line of its own, the {k}th of all" for k in range(60_000))
    got = lines.dedup(spark.createDataFrame([(k, many) for k in range(3)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(0, 60_000), (1, 60_000), (2, 0)]


@pytest.mark.parametrize("name", ["op11_whitening", "op12_merkle", "op13_lines"])
def test_registered(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
