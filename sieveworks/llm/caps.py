"""Embedding near-duplicates through spherical-cap filters of structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm.common import components, saved, sliced

#: Filters that a vector exceeds, on average.
FILTERS = 32
#: Vectors that a filter lists, on average: the codes grow with the root of a group's size, so lists don't.
LISTED = 64
#: Groups of at most so many vectors have one filter, which all exceed.
SMALL = 256
#: A list of more vectors is cut into blocks whose pairs are dealt over tasks.
SPLIT = 4096
#: Vectors with fewer components are padded, so that scores of different filters differ.
LEAST_DIM = 32
#: Vectors that are compared at once, and vectors whose lists are gathered.
BLOCK, CHUNK = 512, 20_000
SAMPLE = 256


class ProductCode:
    """Filter directions (c, d) / sqrt(2) of two random codes after one random rotation; dim, words and seed fix it."""

    def __init__(self, dim: int, words: int, filters: float = FILTERS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim, self.words, self.least = max(dim, LEAST_DIM), words, max(1, round(filters / 4))
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0][:dim]
        self.cut = (self.dim + 1) // 2
        self.codes = []
        for n in (self.cut, self.dim - self.cut):
            c = rng.standard_normal((words, n))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        x = rng.standard_normal((SAMPLE, dim))
        self.threshold = self._exceeded_by(filters, *self._scores(x / np.linalg.norm(x, axis=1, keepdims=True)))

    def _scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x @ self.rotation
        return x[:, : self.cut] @ self.codes[0].T, x[:, self.cut :] @ self.codes[1].T

    def _exceeded_by(self, filters: float, a: np.ndarray, b: np.ndarray) -> float:
        """The threshold that random vectors with these block scores exceed for so many filters on average."""
        b, low, high = np.sort(b, axis=1), 0.0, 2.0
        for _ in range(30):
            middle = (low + high) / 2
            n = sum(self.words * len(x) - int(np.searchsorted(y, middle - x).sum()) for x, y in zip(a, b, strict=True))
            low, high = (middle, high) if n > filters * len(a) else (low, middle)
        return (low + high) / 2

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that each unit row exceeds; a row with few takes its best ones.

        List decoding: a block word is looked at only if its score and the best of the other block reach the threshold.
        """
        a, b = self._scores(x)
        rows, filters = [], []
        top_a, top_b = np.sort(a, axis=1)[:, ::-1][:, : self.least], np.sort(b, axis=1)[:, ::-1][:, : self.least]
        best = np.sort((top_a[:, :, None] + top_b[:, None, :]).reshape(len(x), -1), axis=1)[:, ::-1]
        low = np.minimum(self.threshold, best[:, min(self.least, best.shape[1]) - 1])
        r, i = np.nonzero(a >= (low - b.max(axis=1))[:, None])
        for k in range(0, len(r), 1 << 14):
            r_k, i_k = r[k : k + (1 << 14)], i[k : k + (1 << 14)]
            s, j = np.nonzero(b[r_k] + a[r_k, i_k][:, None] >= low[r_k][:, None])
            rows.append(r_k[s])
            filters.append(i_k[s] * self.words + j)
        return np.concatenate(rows), np.concatenate(filters)


@lru_cache(16)
def product_code(dim: int, words: int, filters: float) -> ProductCode:
    return ProductCode(dim, words, filters)


def code_words(size: int, filters: float) -> int:
    """Words of each block's code for a group of so many vectors, in steps of the root of 2; 0: one filter for all."""
    if size <= SMALL:
        return 0
    return round(2 ** (np.ceil(np.log2(size * filters / LISTED)) / 2))


def unit(v) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or holds null or non-finite components."""
    if v is None:
        return None
    x = np.array([np.nan if c is None else c for c in v], float) if any(c is None for c in v) else np.asarray(v, float)
    if not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def units(vectors: pd.Series) -> np.ndarray:
    """unit() of vectors of one length, none of which is None."""
    x = np.stack(vectors.to_numpy()).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _listed(batches: Iterator[pd.DataFrame], filters: float) -> Iterator[pd.DataFrame]:
    """Adds to (size, v) rows the ascending filters that each vector exceeds."""
    for pdf in sliced(batches):
        found = np.empty(len(pdf), object)
        dims = pdf["v"].map(len).to_numpy()
        words = np.array([code_words(n, filters) for n in pdf["size"]])
        for dim, w in set(zip(dims.tolist(), words.tolist(), strict=True)):
            at = np.flatnonzero((dims == dim) & (words == w))
            if not w:
                found[at] = [np.zeros(1, np.int32)] * len(at)
                continue
            row, f = product_code(dim, w, filters).decode(units(pdf["v"].iloc[at]))
            order = np.lexsort((f, row))
            found[at] = np.split(f[order].astype(np.int32), np.cumsum(np.bincount(row, minlength=len(at)))[:-1])
        yield pdf.assign(filters=found)


def _padded(lists: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists), default=0)), fill, np.int32)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def _share(a: np.ndarray, b: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """Do the pairs of rows share one of the filters before this one? There they are counted."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 4096):
        x, y = _padded([before[i] for i in a[k : k + 4096]], -1), _padded([before[j] for j in b[k : k + 4096]], -2)
        for column in range(x.shape[1]):
            out[k : k + 4096] |= (x[:, column, None] == y).any(axis=1)
    return out


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that the edges reach."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            return label


def _pairs(key: np.ndarray, x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with one key (ascending) and a cosine of at least threshold, some lists or two blocks at a time."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([at, [len(key)]]))
    for size in np.unique(sizes[(sizes > 1) & (sizes <= BLOCK)]).tolist():
        upper = np.triu(np.ones((size, size), bool), 1)
        starts = at[sizes == size]
        step = max(1, CHUNK // size)
        for k in range(0, len(starts), step):
            rows = starts[k : k + step, None] + np.arange(size)
            y = x[rows]
            which, i, j = np.nonzero((y @ y.transpose(0, 2, 1) >= threshold) & upper)
            yield rows[which, i], rows[which, j]
    for start, size in zip(at[sizes > BLOCK].tolist(), sizes[sizes > BLOCK].tolist(), strict=True):
        for p in range(start, start + size, BLOCK):
            for q in range(p, start + size, BLOCK):
                i, j = np.nonzero(x[p : min(p + BLOCK, start + size)] @ x[q : min(q + BLOCK, start + size)].T >= threshold)
                i, j = i + p, j + q
                yield i[i < j], j[i < j]


def _compared(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """(class, links, other): what whole lists, in the order of (group, filter, x, y), say of their classes.

    links counts the rows of other classes that are linked here and share no filter before; other joins the classes as
    the links do.
    """

    def links(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, n, block = pdf["class"].to_numpy(), pdf["n"].to_numpy(), pdf["block"].to_numpy()
        across = pdf["x"].to_numpy() != pdf["y"].to_numpy()
        before = [np.asarray(f, np.int32) for f in pdf["before"]]
        key = pdf.groupby(["group", "filter", "x", "y"], sort=False).ngroup().to_numpy()
        count, edges = np.zeros(len(pdf), np.int64), [(np.empty(0, np.int64),) * 2]
        dims = pdf["v"].map(len).to_numpy()
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            for i, j in _pairs(key[rows], units(pdf["v"].iloc[rows]), threshold):
                i, j = rows[i], rows[j]
                keep = ~across[i] | (block[i] != block[j])  # two different blocks meet here for their cross pairs alone
                i, j = i[keep], j[keep]
                first = ~_share(i, j, before)
                np.add.at(count, i[first], n[j[first]])
                np.add.at(count, j[first], n[i[first]])
                edges.append((i[first], j[first]))
                if sum(len(e[0]) for e in edges) > 1 << 20:  # as few edges as join the same rows
                    label = stars(*(np.concatenate(e) for e in zip(*edges, strict=True)), len(pdf))
                    edges = [(np.arange(len(pdf)), label)]
        label = stars(*(np.concatenate(e) for e in zip(*edges, strict=True)), len(pdf))
        some = (count > 0) | (label != np.arange(len(pdf)))
        yield pd.DataFrame({"class": ids[some], "links": count[some], "other": ids[label[some]]})

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        if sum(map(len, held)) < CHUNK:
            continue
        both = pd.concat(held, ignore_index=True)
        last = both[["group", "filter", "x", "y"]].iloc[-1]
        open_ = (both[["group", "filter", "x", "y"]] == last).all(axis=1).to_numpy()
        if not open_.all():
            yield from links(both[~open_].reset_index(drop=True))
        held = [both[open_]]
    if held:
        yield from links(pd.concat(held, ignore_index=True))


def _entries(lists: DataFrame) -> DataFrame:
    """A row for each vector and filter: (group, filter, x, y, block, class, n, v, before); x and y are the blocks that meet.

    Lists of more than SPLIT vectors are cut into blocks by hash, and each pair of blocks is a list of its own.
    """
    exploded = lists.select("group", "class", "n", "v", "filters", F.posexplode("filters").alias("k", "filter"))
    before = F.slice("filters", F.lit(1), F.col("k"))
    columns = ("class", "n", "v", before.alias("before"))
    sizes = lists.select("group", F.explode("filters").alias("filter")).groupBy("group", "filter").agg(F.count("*").alias("size"))
    hot = sizes.filter(F.col("size") > SPLIT)
    if hot.isEmpty():
        zero = F.lit(0)
        return exploded.select("group", "filter", zero.alias("x"), zero.alias("y"), zero.alias("block"), *columns)
    cut = exploded.join(hot.hint("merge"), ["group", "filter"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / SPLIT), F.lit(1)).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select("group", "filter", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", *columns)


def near_duplicates(rows: DataFrame, threshold: float = 0.93, filters: float = FILTERS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Vectors with equal, not null labels are linked when their cosine in double precision is at least `threshold`;
    null, empty and zero vectors and those with null or non-finite components link with nothing, nor do vectors of
    different lengths. n_links: other rows linked directly; component_id: smallest vec_id reachable, itself included;
    kept: vec_id = component_id.

    Rows with equal label and vector are one class with a count, so copies are never paired. Each class is listed
    under every filter that it exceeds; a filter's classes are compared block by block, and a pair is counted at the
    first filter that both exceed. A task gives counts and joining edges, no more than it has classes, not pairs.
    All links found are true; how many are found follows from `filters` (measured in the tests).

    Rows with null vec_id are ignored; rows that repeat a vec_id are counted as rows, each with its own vector. An empty table gives an empty
    result; other columns are ignored.
    """
    r = rows.filter("vec_id is not null").select("vec_id", F.col("embedding").alias("v"), "label")
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    r = r.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = r.filter("good").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = saved(classes.withColumns({"class": F.monotonically_increasing_id(), "group": F.xxhash64("label", F.size("v"))}), "cap-classes")
    sizes = classes.groupBy("group").agg(F.count("*").alias("size"))
    sized = classes.join(sizes, "group").select("group", "class", "n", "size", "v")
    lists = saved(sized.mapInPandas(lambda b: _listed(b, filters), T.StructType([*sized.schema, T.StructField("filters", T.ArrayType(T.IntegerType()))])), "cap-lists")
    key = ["group", "filter", "x", "y"]
    found = _entries(lists).repartition(*key).sortWithinPartitions(*key, "class").mapInPandas(lambda b: _compared(b, threshold), "class long, links long, other long")
    found = saved(found, "cap-links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found.filter("class != other").select(F.col("class").alias("a"), F.col("other").alias("b")))
    named = classes.select("class", "first", "n").join(links, "class", "left").join(groups.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("class", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.select("class", "label", "v").join(named.join(least, "component").select("class", "n_links", "component_id"), "class")
    on = (F.col("r.label") == F.col("c.label")) & (F.col("r.v") == F.col("c.v")) & F.col("r.good")
    joined = r.alias("r").join(named.alias("c"), on, "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
