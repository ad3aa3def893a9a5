"""Exact substring deduplication by longest-previous-factor arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveworks.llm.common import bounded_batches, gathered, sliced

#: Bytes of the grams whose smallest hash in a window picks the window's bucket.
GRAM = 32
#: Positions hashed at once.
STRETCH = 1 << 20
#: Suffixes that are gathered before they are ordered, and bytes of a suffix that are looked at.
POOL, WIDTH = 1 << 16, 128
#: Runs of one bucket in one part of a task from which on they travel as one row.
PACKED = 8
#: Runs of a bucket beyond which its windows are dealt by their own hash.
HOT = 5000
#: Contexts that a task remembers to find equal ones before they are shuffled.
REMEMBERED = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes, by doubling from 8-byte words."""
    n = len(data) - 7
    h = np.ndarray((n,), "<u8", data, strides=(1,)) * _MIX
    w = 8
    while w < GRAM:
        h = (h[:-w] ^ (h[:-w] >> np.uint64(29))) * _MIX2 + h[w:]
        w *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def buckets(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first, n): runs of positions whose strings of `length` bytes have the same smallest gram, first met at the same place.

    Equal strings have equal buckets wherever they stand, and one run holds no string twice. Every position with
    length bytes after it is in one run.
    """
    out = []
    for at in range(0, len(data) - length + 1, STRETCH):
        m = g = gram_hashes(data[at : at + STRETCH + length - 1])
        need, w = length - GRAM + 1, 1
        while w * 2 <= need:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        if need > w:
            m = np.minimum(m[: len(m) - (need - w)], m[need - w :])
        start = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (g[: len(m) - 1] == m[:-1])]))
        size = np.diff(np.concatenate([start, [len(m)]]))
        out.append((m[start], start + at, size))
    if not out:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array: for each position, its longest match with a smaller position.

    order: positions in suffix order; lcp[k]: common prefix of order[k] and order[k - 1] (lcp[0] is 0). The longest
    match is with the previous or the next smaller position in suffix order; one pass with a stack finds both.
    """
    lpf = np.zeros(len(order), np.int64)
    stack: list[int] = []
    shared: list[int] = []  # the common prefix of each on the stack with the smaller one below it
    for p, common in zip(order.tolist(), lcp.tolist(), strict=True):
        while stack and stack[-1] > p:
            # p is the next smaller position of the top
            top, below = stack.pop(), shared.pop()
            lpf[top] = max(below, common)
            common = min(common, below)
        stack.append(p)
        shared.append(common if len(stack) > 1 else 0)
    for top, below in zip(stack, shared, strict=True):
        lpf[top] = max(lpf[top], below)
    return lpf


def suffix_order(rows: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of suffixes given as a matrix of their leading bytes and their sizes, zeros after them."""
    width = rows.shape[1]
    order = np.argsort(rows.view(f"V{width}").ravel(), kind="stable")
    differ = rows[order[1:]] != rows[order[:-1]]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.minimum(lcp, np.minimum(room[order[1:]], room[order[:-1]]))
    return order, np.concatenate([[0], lcp])


def later_copies(contexts: list[bytes], places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, sizes) of the matches of `length` bytes or more with an earlier position, by the longest-previous-factor array.

    places holds a row (doc_id, row, start) for each context's first byte; a suffix ends with its context or after
    WIDTH bytes. Only positions whose first `length` bytes have a hash that comes twice can match, so only their
    suffixes are ordered.
    """
    data = b"".join(contexts)
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    sizes = lengths - length + 1
    of = np.repeat(np.arange(len(contexts)), sizes)
    k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(np.cumsum(lengths) - lengths, sizes) + k
    g = gram_hashes(data)
    hashes = g[at] + g[at + (length - GRAM) // 2] * np.uint64(3) + g[at + length - GRAM] * np.uint64(5)
    _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[back] > 1)
    of, k, at = of[again], k[again], at[again]
    found = places[of]
    found[:, 2] += k
    order = np.lexsort(found.T[::-1])  # positions are numbered in the order of the input
    of, k, at, found = of[order], k[order], at[order], found[order]
    width = max(WIDTH, length)
    room = np.minimum(lengths[of] - k, width)
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(width), np.uint8), width)[at]
    rows[np.arange(width) >= room[:, None]] = 0
    factors = previous_factors(*suffix_order(rows, room))
    hit = factors >= length
    return found[hit], factors[hit]


def _ranges(found: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """Matches in the order of the input as the byte ranges that they cover."""
    ends = found[:, 2] + sizes
    new = np.flatnonzero(np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1) | (found[1:, 2] > ends[:-1])]))
    return pd.DataFrame({"doc_id": found[new, 0], "row": found[new, 1], "a": found[new, 2], "b": np.maximum.reduceat(ends, new)})


_RUN, _CONTEXT, _RANGE = "h long, doc_id long, row int, at int, n int", "h long, doc_id long, row int, at int, size int, ctx binary", "doc_id long, row int, a long, b long"


def _hashed(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The runs of (doc_id, row, data). Many runs of a bucket in one part are one row, the others packed into `more`."""
    for pdf in sliced(batches):
        found = [buckets(bytes(data), length) for data in pdf["data"]]
        sizes = [len(f[0]) for f in found]
        if not sum(sizes):
            continue
        h = np.concatenate([f[0] for f in found]).view(np.int64)
        runs = np.stack([np.repeat(pdf["doc_id"].to_numpy(), sizes), np.repeat(pdf["row"].to_numpy(), sizes), *(np.concatenate([f[k] for f in found]) for k in (1, 2))], axis=1)
        order = np.argsort(h, kind="stable")
        h, runs = h[order], runs[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(h)]]))
        keep, more = np.ones(len(h), bool), np.full(len(h), None, object)
        for a, n in zip(starts[counts >= PACKED].tolist(), counts[counts >= PACKED].tolist(), strict=True):
            keep[a + 1 : a + n] = False
            more[a] = runs[a + 1 : a + n].tobytes()
        yield pd.DataFrame({"h": h[keep], **{c: runs[keep, k] for k, c in enumerate(("doc_id", "row", "at", "n"))}, "more": more[keep]})


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs, in the order of h, of buckets with several; those of a bucket with over HOT have a negative n."""
    hot: int | None = None

    def unpacked(part: pd.DataFrame) -> pd.DataFrame:
        nonlocal hot
        packed = part["more"].notna()
        lists = [np.frombuffer(bytes(x), np.int64).reshape(-1, 4) for x in part["more"][packed]]
        rest = np.concatenate(lists) if lists else np.empty((0, 4), np.int64)
        out = pd.concat([part.drop(columns="more"), pd.DataFrame({"h": np.repeat(part["h"][packed].to_numpy(), [len(x) for x in lists]), **{c: rest[:, k] for k, c in enumerate(("doc_id", "row", "at", "n"))}})], ignore_index=True)
        size = out.groupby("h")["n"].transform("size")
        many = (size > HOT) | (out["h"] == hot)
        out["n"] = np.where(many, -out["n"], out["n"])
        return out[many | (size > 1)]

    held = None
    for pdf in gathered(batches, 1):
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = int(pdf["h"].iloc[-1])
        cut = int(np.searchsorted(pdf["h"].to_numpy(), last))
        if cut:
            yield unpacked(pdf.iloc[:cut])
        held = pdf.iloc[cut:]
        if hot == last or sum(len(x) // 32 for x in held["more"].dropna()) + len(held) > HOT:
            hot = last
            yield unpacked(held)
            held = None
    if held is not None:
        yield unpacked(held)


def _contexts(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The bytes of each run of (doc_id, row, data, runs), in the order of the input; a hot bucket's windows one by one.

    A context that the task has met before is a later copy whatever others hold: it goes on as a range (null ctx, its
    h only spreads such rows), so of equal contexts only few are gathered.
    """
    met: set[int] = set()
    out: list[tuple] = []
    ranges: list[list[int]] = []
    names = [c.split()[0] for c in _CONTEXT.split(", ")]

    def put(h: int, doc: int, row: int, at: int, ctx: bytes) -> None:
        name = xxhash.xxh3_128_intdigest(ctx)
        if name in met:
            if ranges and at <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], at + len(ctx))
            else:
                ranges.append([at, at + len(ctx)])
            return
        if len(met) >= REMEMBERED:
            met.clear()
        met.add(name)
        out.append((h, doc, row, at, len(ctx), ctx))

    for pdf in sliced(batches):
        for doc, row, data, runs in zip(pdf["doc_id"].tolist(), pdf["row"].tolist(), pdf["data"], pdf["runs"], strict=True):
            data, ranges = bytes(data), []
            for at, h, n in sorted((x["at"], x["h"], x["n"]) for x in runs):
                if n > 0:
                    put(h, doc, row, at, data[at : at + n - 1 + length])
                    continue
                for k in range(at, at - n):
                    window = data[k : k + length]
                    put(h ^ (xxhash.xxh64_intdigest(window) >> 1), doc, row, k, window)
            out.extend(((doc * 31 + a) & 0x7FFFFFFFFFFFFFFF, doc, row, a, b - a, None) for a, b in ranges)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
    if out:
        yield pd.DataFrame(out, columns=names)


def _compared(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The ranges of later copies among contexts in the order of (h, doc_id, row, at)."""
    pool: list[tuple[bytes, int, int, int]] = []
    bucket: dict[bytes, tuple[int, int, int]] = {}
    whole: list[tuple[int, int, int, int]] = []
    now, waiting = None, 0

    def close() -> None:
        nonlocal waiting
        if len(bucket) > 1:
            pool.extend((c, *place) for c, place in bucket.items())
            waiting += sum(len(c) - length + 1 for c in bucket)
        bucket.clear()

    def flush() -> Iterator[pd.DataFrame]:
        nonlocal waiting
        if pool:
            found, sizes = later_copies([p[0] for p in pool], np.array([p[1:] for p in pool]), length)
            if len(found):
                yield _ranges(found, sizes)
        if whole:
            yield pd.DataFrame(whole, columns=["doc_id", "row", "a", "b"])
        pool.clear()
        whole.clear()
        waiting = 0

    for pdf in batches:
        for h, doc, row, at, size, c in zip(*(pdf[x].tolist() for x in ("h", "doc_id", "row", "at", "size", "ctx")), strict=True):
            if c is None:
                whole.append((doc, row, at, at + size))
                continue
            if h != now:
                close()
                now = h
                if waiting > POOL:
                    yield from flush()
            if c in bucket:  # an equal context came earlier: all its strings are later copies
                whole.append((doc, row, at, at + size))
            else:
                bucket[c] = (doc, row, at)
        if len(whole) > 50_000:
            yield pd.DataFrame(whole, columns=["doc_id", "row", "a", "b"])
            whole.clear()
    close()
    yield from flush()


def _of_row(texts: DataFrame, of: DataFrame, how: str) -> DataFrame:
    """texts joined with what `of` says of their (doc_id, row). Texts are dealt by doc_id alone, once, so row isn't a join key."""
    of = of.withColumnsRenamed({"doc_id": "of_doc", "row": "of_row"}).hint("merge")
    joined = texts.join(of, (F.col("doc_id") == F.col("of_doc")) & (F.col("row") - F.col("of_row") == 0), how)
    return joined.drop("of_doc", "of_row")


def removed_ranges(texts: DataFrame, every: DataFrame, length: int) -> DataFrame:
    """(doc_id, row, a long, b long): byte ranges, together all bytes of a later copy of a `length`-byte string.

    texts: (doc_id, row, data binary); every: the same rows or more, from which contexts are cut. Positions are put in
    buckets such that equal strings share one; contexts of buckets with several rows are shuffled, and each bucket's
    suffixes are ordered. A bucket with very many rows is split by the strings themselves.
    """
    runs = texts.select("doc_id", "row", "data").mapInPandas(lambda b: _hashed(b, length), f"{_RUN}, more binary")
    several = runs.repartition("h").sortWithinPartitions("h").mapInPandas(_shared, _RUN)
    by_doc = several.repartition("doc_id").groupBy("doc_id", "row").agg(F.collect_list(F.struct("h", "at", "n")).alias("runs"))
    ctx = _of_row(every, by_doc, "inner").select("doc_id", "row", "data", "runs").mapInPandas(lambda b: _contexts(b, length), _CONTEXT)
    return ctx.repartition("h").sortWithinPartitions("h", "doc_id", "row", "at").mapInPandas(lambda b: _compared(b, length), _RANGE)


def dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row of docs.

    Each byte covered by a `length`-byte string that also starts earlier (smaller doc_id, or in the same document
    before) is removed; matches never cross documents, overlaps count, and strings are judged on the input. n_spans
    counts the maximal removed runs; kept holds the remaining bytes.

    Rows whose whole text an earlier row has are settled by digest before suffixes are compared: a text of `length`
    bytes or more goes whole, a shorter one stays. Null text: empty. Rows of one doc_id are documents of their own,
    ordered by a hash of their text and the text; of equal rows one is the first and keeps its bytes. Rows with a null
    doc_id are kept whole and compared with nothing. Other columns are ignored. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("data"), "data")
    # the three uses of the texts have the same plan up to their exchange by doc_id, so Spark shuffles them once
    known_id = d.filter("doc_id is not null").withColumn("row", F.row_number().over(order))
    digests = known_id.select("doc_id", "row", F.sha2("data", 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.doc_id", "first.row").withColumn("is_first", F.lit(True))
    texts = _of_row(known_id, firsts.drop("is_first"), "left_semi")
    ranges = removed_ranges(texts, known_id, length).repartition("doc_id").groupBy("doc_id", "row").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    joined = _of_row(_of_row(known_id, firsts, "left"), ranges, "left").select("doc_id", "data", "is_first", "ranges")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            out = []
            for data, first, ranges in zip(pdf["data"], pdf["is_first"], pdf["ranges"], strict=True):
                data, merged = bytes(data), []
                if first is not True and len(data) >= length:
                    merged = [[0, len(data)]]
                elif ranges is not None:
                    for a, b in sorted((x["a"], x["b"]) for x in ranges):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                edges = [0, *(x for r in merged for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(merged), kept))
            yield pd.DataFrame(out, index=pdf.index, columns=["n_bytes", "n_removed", "n_spans", "kept"]).assign(doc_id=pdf["doc_id"])

    no_id = d.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("data").alias("kept"))
    return joined.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").union(no_id)
