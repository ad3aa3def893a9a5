"""Whitening of embeddings: covariances by Welford's rank-one updates, merged in parallel, and a symmetric QR eigen-solve."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sieveworks.llm.common import saved

#: Components of a whitened vector, partial covariances that one task merges, and steps of an entry.
COMPONENTS, FANIN, STEPS = 4, 16, 256
OWN = ("n", "deviation", "whitened", "explained", "identity_error")
_STATE = "n long, mean array<double>, sums array<double>, exact array<decimal(38,0)>"


class Moments:
    """Count, exact sums, mean and summed products of deviations of the vectors seen so far."""

    def __init__(self, size: int):
        self.n, self.exact = 0, [0] * size
        self.mean, self.products = np.zeros(size), np.zeros((size, size))
        self._room = np.empty((size, size))

    def update(self, vectors: np.ndarray) -> None:
        """Welford's step for each vector: the mean moves, and one product of old and new deviation is added."""
        for row in vectors.astype(np.float64):
            self.n += 1
            before = row - self.mean
            self.mean += before / self.n
            np.multiply(before[:, None], row - self.mean, out=self._room)
            self.products += self._room

    def count(self, vectors: np.ndarray) -> None:
        """Adds to the exact sums, in Python's integers where a long might not do."""
        if len(vectors):
            small = np.abs(vectors.astype(np.float64)).max() * len(vectors) < 2**62
            found = vectors.sum(axis=0) if small else vectors.astype(object).sum(axis=0)
            self.exact = [a + int(b) for a, b in zip(self.exact, found, strict=True)]

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray, exact: list[int]) -> None:
        """The parallel formula: both sums of products, and that of the two means' difference."""
        if n:
            both, apart = self.n + n, mean - self.mean
            self.products += products + np.outer(apart, apart) * (self.n * (n / both))
            self.mean += apart * (n / both)
            self.n = both
            self.exact = [a + int(b) for a, b in zip(self.exact, exact, strict=True)]

    def covariance(self) -> np.ndarray:
        half = self.products / max(self.n, 1)
        return (half + half.T) / 2

    def frame(self) -> pd.DataFrame:
        from decimal import Decimal

        return pd.DataFrame({"n": [self.n], "mean": [self.mean], "sums": [self.products.ravel()], "exact": [[Decimal(x) for x in self.exact]]})


def moments(vectors: DataFrame, size: int, name: str = "moments") -> Moments:
    """Moments of the one column of vectors, arrays of ``size`` numbers without nulls.

    Every task streams its rows through one state of size * size numbers; states are saved and merged FANIN at a time
    until one is left, which alone reaches the driver.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Moments(size)
        for pdf in batches:
            if len(pdf):
                block = np.stack(pdf.iloc[:, 0].to_numpy())
                state.update(block)
                if block.dtype.kind == "i":
                    state.count(block)
        yield state.frame()

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Moments(size)
        for pdf in batches:
            for r in pdf.itertuples():
                state.merge(r.n, np.asarray(r.mean), np.asarray(r.sums).reshape(size, size), r.exact)
        if state.n:
            yield state.frame()

    states = saved(vectors.mapInPandas(partial, _STATE), name)
    while (left := states.count()) > 1:
        states = saved(states.repartition(-(-left // FANIN)).mapInPandas(merged, _STATE), name)
    whole = Moments(size)
    for r in states.toLocalIterator():
        whole.merge(r.n, np.asarray(r.mean), np.asarray(r.sums).reshape(size, size), r.exact)
    return whole


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, lower diagonal and Q of a symmetric matrix, which is Q T Q', by Householder's reflections."""
    a, q = matrix.astype(np.float64, copy=True), np.eye(len(matrix))
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        norm = math.copysign(np.linalg.norm(x), x[0])
        if not np.abs(x[1:]).max() > 0:
            continue
        v = x.copy()
        v[0] += norm
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - v * (v @ p)
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -norm
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, by the implicit symmetric QR iteration.

    Each sweep chases a bulge down an unreduced block of the tridiagonal form, with Wilkinson's shift; entries beside the
    diagonal that rounding can't tell from zero split the blocks.
    """
    d, e, q = tridiagonal(matrix)
    vectors = np.ascontiguousarray(q.T)
    tiny, high = np.finfo(np.float64).eps, len(d) - 1
    while high > 0:
        for k in range(high):
            if abs(e[k]) <= tiny * (abs(d[k]) + abs(d[k + 1])):
                e[k] = 0.0
        if e[high - 1] == 0:
            high -= 1
            continue
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        half, side = (d[high - 1] - d[high]) / 2, e[high - 1]
        shift = d[high] - side * side / (half + math.copysign(math.hypot(half, side), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            up, at, down = d[k], e[k], d[k + 1]
            d[k] = c * c * up + 2 * c * s * at + s * s * down
            d[k + 1] = s * s * up - 2 * c * s * at + c * c * down
            e[k] = c * s * (down - up) + (c * c - s * s) * at
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            vectors[k], vectors[k + 1] = c * vectors[k] + s * vectors[k + 1], c * vectors[k + 1] - s * vectors[k]
    order = np.argsort(-d, kind="stable")
    return d[order], vectors[order]


class Whitening(NamedTuple):
    """What fit() learns: count and exact sums of the fit list, its mean, and the projections to whitened components."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: tuple[float, ...]
    identity_error: float | None


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty, and holds no null, NaN or infinity."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def steps(vector: Column) -> Column:
    """Each entry c as the long floor(256 * c)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(STEPS)).cast("long"))


def _projected(model: Whitening):
    mean, scaled = model.mean, model.vectors / np.sqrt(model.values)[:, None]

    def project(block: np.ndarray) -> np.ndarray:
        return (block.astype(np.float64) - mean) @ scaled.T

    return project


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of the column ``x`` (arrays of longs of one size); None where there is none.

    Vectors are made distinct with a partial aggregate first, so copies of one meet as a row for each task. The fit list
    is saved and streamed twice: for the covariance, and for that of its whitened vectors, whose largest difference
    from the identity is measured, not assumed.

    Components whose eigenvalue is zero to rounding (fewer vectors or dimensions than components, equal vectors) are
    left out.
    """
    one = vectors.select("x").distinct()
    listed = saved(one, "whitening-list")
    size = listed.select(F.size("x")).first()
    if size is None:
        return None
    size = size[0]
    found = moments(listed, size)
    values, rows = eigen(found.covariance())
    trace = float(np.trace(found.covariance()))
    rank = int((values > max(trace, 0.0) * size * np.finfo(np.float64).eps).sum())
    keep = min(components, rank)
    mean = np.array([x / found.n for x in found.exact])
    model = Whitening(found.n, tuple(found.exact), mean, values[:keep], rows[:keep], tuple(float(v / trace) for v in values[:keep]), None)
    if not keep:
        return model
    project = _projected(model)

    def whitened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"y": list(project(np.stack(pdf["x"].to_numpy())))})

    again = moments(listed.mapInPandas(whitened, "y array<double>"), keep, "whitened-moments")
    return model._replace(identity_error=float(np.abs(again.covariance() - np.eye(keep)).max()))


def _deviation(block: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sums of (n * x - S)^2, by longs where they suffice; null where a result is beyond a long."""
    low, high = block.min(axis=0), block.max(axis=0)
    most = max(abs(n * int(x) - s) for ends in (low, high) for x, s in zip(ends, sums, strict=True))
    wide = most * most * len(sums) >= 2**63 or n * max(int(high.max()), -int(low.min())) >= 2**63 or max(map(abs, sums)) >= 2**63
    off = (block.astype(object) if wide else block) * n - np.array(sums, dtype=object if wide else np.int64)
    return [int(x) if x < 2**63 else None for x in (off * off).sum(axis=1)]


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The usable rows with ``n``, ``deviation``, ``whitened`` (array), ``explained`` (array) and ``identity_error``.

    A vector's entries become longs x = floor(256 * entry); the fit list is each distinct x once, n of them, with sums
    S. whitened: x - S/n, projected on the leading unit eigenvectors of the fit list's covariance (divisor n), each
    over the root of its eigenvalue; explained: eigenvalues over the trace; deviation: the sum of (n*x - S)^2;
    identity_error: how far the whitened fit list's covariance is from the identity at most.

    Rows whose vector is null, empty, or holds null, NaN or infinite entries are dropped, and so are those whose vector
    has another length than the most frequent one (of equally frequent lengths, the longest). Equal vectors count once;
    repeated rows get the same result each. Fewer components come where the covariance has less rank; none (empty
    arrays) where all vectors are equal. A deviation beyond a long is null. Entries beyond the longs stop at their ends.
    Empty table: no rows. Null ids and other columns, whatever their names, stay; columns of OWN are replaced.
    """
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in OWN]
    good = rows.filter(usable(F.col(f"`{vector}`")))
    lengths = good.groupBy(F.size(F.col(f"`{vector}`")).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    good = good.filter(F.size(F.col(f"`{vector}`")) == (lengths["size"] if lengths else 0))
    model = fit(good.select(steps(F.col(f"`{vector}`")).alias("x")), components) if lengths else None
    if model is None:
        project, n, sums = None, 0, ()
    else:
        project, n, sums = (_projected(model) if len(model.values) else None), model.n, model.sums

    @pandas_udf("deviation long, whitened array<double>")
    def scored(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"deviation": pd.Series(dtype="Int64"), "whitened": []})
        block = np.stack(x.to_numpy())
        found = list(project(block)) if project else [[]] * len(block)
        return pd.DataFrame({"deviation": pd.Series(_deviation(block, n, sums), dtype="Int64"), "whitened": found})

    out = good.select(*keep, scored(steps(F.col(f"`{vector}`"))).alias("scored"))
    explained = F.array(*map(F.lit, model.explained)) if model and model.explained else F.array()
    error = F.lit(model.identity_error if model else None).cast("double")
    return out.select(*keep, F.lit(n).cast("long").alias("n"), "scored.deviation", "scored.whitened", explained.cast("array<double>").alias("explained"), error.alias("identity_error"))
