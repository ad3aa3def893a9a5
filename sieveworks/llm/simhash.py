"""SimHash near-duplicates joined by Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import shingles
from sieveworks.llm.common import components, saved, sliced

#: Generator polynomial of the binary Golay code of length 23: x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011
#: A bucket of more fingerprints than this is compared block by block.
BLOCK = 2048
HASH_CHUNK = 1 << 16
#: Fingerprints of a bucket beyond which it is dealt anew by finer keys.
LARGE = 1 << 14


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half the shingles' XXH64 (seed 42).

    A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, every run of shingle_words words joined by one space (fewer words:
    the whole sequence). None, empty and white-space texts: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle_words, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, HASH_CHUNK):
        part = [h(joined[a:b], 42) for a, b in zip(starts[k : k + HASH_CHUNK].tolist(), last[k : k + HASH_CHUNK].tolist(), strict=False)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp long): the SimHash of every whole text. Null texts count as empty: 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            fp = np.array([fingerprint(t, shingle_words) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes: the up to 6 error patterns of weight 4 or less (padded by the first); and each byte's part of the syndrome.

    The code is perfect: one pattern of weight 3 or less, and where that has weight 3, 5 more of weight 4.
    """

    def syndrome(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    unit = [syndrome(1 << k) for k in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            found[s].append(sum(1 << b for b in bits))
    light = [[e for e in f if e.bit_count() <= 3] for f in found]
    found = [f if light[s][0].bit_count() == 3 else light[s] for s, f in enumerate(found)]
    patterns = np.array([(f + [f[0]] * 6)[:6] for f in found], np.int64)
    parts = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for v in range(256):
            for b in range(8):
                if v >> b & 1 and byte * 8 + b < 23:
                    parts[byte, v] ^= unit[byte * 8 + b]
    return patterns, parts


def golay_keys(x: np.ndarray) -> np.ndarray:
    """The 12-bit indices of all codewords within 4 bits of each 23-bit x, 6 columns (repeated where fewer).

    Words that differ in at most 2 bits share one: the codeword nearest to their midpoint is within 3 of it, so
    within 4 of both.
    """
    patterns, parts = golay_tables()
    s = parts[0, x & 255] ^ parts[1, x >> 8 & 255] ^ parts[2, x >> 16]
    return (x[:, None] ^ patterns[s]) >> 11


def cut(n: int, k: int) -> list[tuple[int, int]]:
    """n bits in k runs as (start, length)."""
    at = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _layout(errors: int, exact: int) -> Iterator[tuple[list[tuple[int, int]], list[list[int]]]]:
    """For each choice of exact segments: their (start, length), and the runs of the other bits of which one is decoded."""
    segments = cut(64, errors + exact)
    for taken in combinations(range(len(segments)), exact):
        rest = [b for i, (a, n) in enumerate(segments) if i not in taken for b in range(a, a + n)]
        yield [segments[i] for i in taken], [rest[a : a + min(n, 23)] for a, n in cut(len(rest), errors // 3 + 1)]


def bucket_keys(fp: np.ndarray, errors: int, exact: int) -> Iterator[np.ndarray]:
    """64-bit keys of each fingerprint such that two within `errors` bits share at least one.

    Pigeonhole: of errors + exact segments, `exact` are free of errors; the bits outside them fall into runs of at
    most 23 of which one has at most errors // runs (2 or fewer) errors; that run is Golay-decoded to the codewords near it. A key holds which
    segments and run were taken, the exact bits and the codeword's index.
    """
    width = -(-64 // (errors + exact))
    for number, (taken, runs) in enumerate(_layout(errors, exact)):
        base = np.full(len(fp), number, np.int64)
        for a, n in taken:
            base = base << width | (fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64)
        for r, run in enumerate(runs):
            x = np.zeros(len(fp), np.int64)
            for k, b in enumerate(run):
                x |= (fp >> np.uint64(b) & np.uint64(1)).astype(np.int64) << k
            keys = np.sort(golay_keys(x), axis=1)
            yield (base * len(runs) + r)[:, None] << 12 | keys


def free_bits(key: int, errors: int, exact: int) -> list[int]:
    """The bits that a bucket's key says nothing of: neither exact nor of the decoded run."""
    runs = errors // 3 + 1
    top, r = divmod(key >> 12, runs)
    taken, decoded = list(_layout(errors, exact))[top >> -(-64 // (errors + exact)) * exact]
    fixed = {b for a, n in taken for b in range(a, a + n)} | set(decoded[r])
    return [b for b in range(64) if b not in fixed]


def near(a: np.ndarray, b: np.ndarray, errors: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= errors


def linked(fp: np.ndarray, errors: int) -> list[tuple[int, int]]:
    """Edges that join the distinct fingerprints as all links within `errors` bits do: no more edges than fingerprints.

    Labels fall to the least position reached, block against block, until none changes.
    """
    n = len(fp)
    label = np.arange(n)
    blocks = [slice(k, min(k + BLOCK, n)) for k in range(0, n, BLOCK)]
    while True:
        old = label.copy()
        for i, x in enumerate(blocks):
            for y in blocks[i:]:
                m = near(fp[x], fp[y], errors)
                label[x] = np.minimum(label[x], np.where(m, label[y][None, :], n).min(axis=1))
                label[y] = np.minimum(label[y], np.where(m, label[x][:, None], n).min(axis=0))
        label = label[label]
        if (label == old).all():
            break
    at = np.flatnonzero(label != np.arange(n))
    return list(zip(fp[at].view(np.int64).tolist(), fp[label[at]].view(np.int64).tolist(), strict=True))


def _keyed(batches: Iterator[pd.DataFrame], errors: int, exact: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        for keys in bucket_keys(fp, errors, exact):
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            yield pd.DataFrame({"key": keys[new], "fp": np.repeat(pdf["fp"].to_numpy(), new.sum(axis=1))})


def _finer(key: int, fp: np.ndarray, errors: int, exact: int) -> pd.DataFrame:
    """A large bucket's fingerprints under a key for each two of errors + 2 segments of the bits that the bucket's key leaves free.

    Two within `errors` bits have at least two of the segments in common.
    """
    free = free_bits(key, errors, exact)
    parts = []
    for a, n in cut(len(free), errors + 2):
        part = np.zeros(len(fp), np.uint64)
        for k, b in enumerate(free[a : a + n]):
            part |= (fp.view(np.uint64) >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
        parts.append(part)
    keys = []
    for number, (x, y) in enumerate(combinations(parts, 2)):
        mixed = (x << np.uint64(20) | y | np.uint64(number << 40)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (1 << 64) - 1)
        keys.append((mixed ^ mixed >> np.uint64(31)).view(np.int64))
    return pd.DataFrame({"a": np.tile(fp, len(keys)), "b": np.tile(fp, len(keys)), "key": np.concatenate(keys)})


def _compared(batches: Iterator[pd.DataFrame], errors: int, exact: int, large: int | None) -> Iterator[pd.DataFrame]:
    """Edges (a, b) of the buckets in key order; the rows of one with over `large` fingerprints go on with a finer key."""

    def edges(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(at)
        two = at[:-1][size == 2]
        near2 = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= errors]
        out = [np.stack([fp[near2], fp[near2 + 1]], axis=1)]
        for a, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if e := linked(np.unique(fp[a : a + n]).view(np.uint64), errors):
                out.append(np.array(e, np.int64))
        found = np.concatenate(out)
        return pd.DataFrame({"a": found.max(axis=1), "b": found.min(axis=1), "key": None}).drop_duplicates(["a", "b"])

    key, fp, going = np.empty(0, np.int64), np.empty(0, np.int64), None
    for pdf in batches:
        key, fp = np.concatenate([key, pdf["key"].to_numpy()]), np.concatenate([fp, pdf["fp"].to_numpy()])
        if not len(key):
            continue
        if going is not None:  # the rest of a large bucket
            n = int(np.searchsorted(key, going, "right"))
            yield _finer(going, fp[:n], errors, exact)
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            going = None
        whole = int(np.searchsorted(key, key[-1]))
        if whole:
            yield edges(key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
        if large is not None and len(key) > large:
            going = int(key[0])
            yield _finer(going, fp, errors, exact)
            key, fp = key[:0], fp[:0]
    if len(key):
        yield edges(key, fp)


def links(fps: DataFrame, errors: int = 4, exact: int | None = None) -> DataFrame:
    """(a, b) of distinct fingerprints (fp long): edges with the same components as all links within `errors` bits.

    Keys are shuffled, never pairs; a bucket's edges are fewer than its fingerprints. Rows of a bucket arrive in key
    order over Arrow batches, and only the open bucket is held. Keys hold more exact bits for larger tables, so that
    buckets stay small; a bucket that is large for all that is dealt once more, by segments of the bits that its key leaves free.
    """
    if exact is None:
        n = fps.count()
        exact = 1 if n < 1 << 26 else 2 if n < 1 << 34 else 3
    edge = "a long, b long, key long"
    keys = fps.select("fp").mapInPandas(lambda b: _keyed(b, errors, exact), "key long, fp long")
    found = keys.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(lambda b: _compared(b, errors, exact, LARGE), edge)
    found = saved(found, "simhash-edges")
    near_, large = found.filter("key is null").select("a", "b"), found.filter("key is not null").select("key", F.col("a").alias("fp"))
    if not large.isEmpty():
        again = large.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(lambda b: _compared(b, errors, exact, None), edge)
        near_ = near_.union(again.select("a", "b"))
    return near_.distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 4, errors: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document with a doc_id.

    Documents whose fingerprints differ in at most `errors` bits are linked; component_id is the smallest doc_id
    reachable, itself included. Equal fingerprints are one node, so copies cost nothing beyond their count, and no
    link between different fingerprints is lost. fingerprint: 16 lower-case hex digits. Null and empty texts have
    fingerprint 0 and are linked like any other; rows with null doc_id get a component_id like the rest; repeated
    rows stay; an empty table gives an empty result; other columns are ignored.
    """
    fps = saved(fingerprints(docs, shingle_words), "simhash")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    groups = components(links(nodes, errors))
    nodes = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    nodes = saved(nodes, "simhash-nodes")
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = nodes.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents that are the smallest doc_id of their near-duplicate group; columns as in docs. Rows with null doc_id stay.

    Groups are of shingle sets with a Jaccard similarity of at least `similarity`. Pairs come from fingerprints within 4
    bits by their Golay keys, and are held against the sets. Fingerprints alone cannot find all: at 0.8 two of them
    differ in 10 bits on average, and keys for so many errors leave no bits to tell texts apart; MinHash bands add the rest.
    """
    groups = shingles.near_duplicates(docs, shingle_words, similarity, links)
    gone = groups.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
