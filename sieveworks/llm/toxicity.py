"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found through a block-max inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sieveworks.llm.common import saved, sliced

WORD = re.compile(r"\w+")
#: Bytes of UTF-8 with a space for all of ASCII that is no part of a word.
SPACED = bytes(b if b > 127 or WORD.match(chr(b)) else 32 for b in range(256))
#: Labelled rows that a fit uses at most, those with the smallest hash of their id.
MAX_EXAMPLES = 5_000
#: One in so many of them is left out of a first index, to calibrate the votes.
FOLDS = 5
NEIGHBOURS = 15
#: Weight of the base rate among the votes, and of the identity in the calibration, in rows.
PRIOR, STEADY = 0.05, 4.0
#: Examples of a block, and postings that a query reads before it first looks at what can still be reached.
BLOCK, FIRST = 64, 4096
#: Texts whose words a worker numbers at once, and words whose numbers it remembers.
TOGETHER, WORDS = 64, 1 << 17
#: An example's number in a term's postings, a term's in an example's, and the weight; in 8 bytes, so that runs are copied at once.
POSTING = np.dtype([("of", np.int32), ("weight", np.float32)])


def words(text: str | None) -> Counter[bytes]:
    """A whole text's words in lower case, as WORD finds them, in UTF-8, and their counts."""
    found = Counter((text or "").lower().encode("utf-8", "surrogatepass").translate(SPACED).split())
    for piece in [x for x in found if not x.isascii()]:
        read = piece.decode("utf-8", "surrogatepass")
        if not WORD.fullmatch(read):
            n = found.pop(piece)
            for word in WORD.findall(read):
                found[word.encode("utf-8", "surrogatepass")] += n
    return found


def hashes(found: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, n)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a whole text's words in lower case, ascending, and their counts."""
    found = words(text)
    at, n = hashes(found, len(found)), np.fromiter(found.values(), np.int32, len(found))
    order = np.argsort(at)
    return at[order], n[order]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _packed(of: np.ndarray, weight: np.ndarray) -> np.ndarray:
    packed = np.empty(len(of), POSTING)
    packed["of"], packed["weight"] = of, weight
    return packed.view(np.int64)


def _runs(packed: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The postings of runs, one after the other."""
    return np.concatenate([packed[:0], *(packed[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))]).view(POSTING)


def _least(score: np.ndarray, k: int) -> float:
    """What an example must reach to be among the k nearest; the slack is over the error of 32-bit weights and of cosines to 6 places."""
    return float(np.partition(score, -k)[-k]) * (1 - 1e-4) - 1e-6 if len(score) > k else 0.0


class NearestExamples:
    """An inverted index of the labelled examples, all terms of each; postings hold weights at length 1, blocks their largest.

    A term weighs its idf times the size of its class log odds, smoothed by half an example: the weight of a term that
    a given share of each class holds does not grow with the number of examples. Both classes' terms weigh alike.
    Examples are numbered by label and id, so that the blocks of BLOCK examples are alike.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, at: list[np.ndarray], n: list[np.ndarray]):
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order].astype(float)
        n1 = int(self.labels.sum())
        n0 = len(ids) - n1
        # below a half where both classes are equally common: a text that no example is like is no case
        self.base = n1 / (n1 + n0 + 1)
        self.slope, self.shift = 1.0, 0.0
        if not n1 or not n0:
            self.ids, self.labels, order = self.ids[:0], self.labels[:0], order[:0]
        sizes = np.array([len(at[k]) for k in order], np.int64)
        flat = np.concatenate([at[k] for k in order]) if len(order) else np.empty(0, np.uint64)
        self.hashes, posted = np.unique(flat, return_inverse=True)
        example = np.repeat(np.arange(len(order)), sizes)
        df = np.bincount(posted, minlength=len(self.hashes))
        common = np.argsort(-df, kind="stable")  # terms are numbered by how common they are, so that what is read often lies together
        self.number = np.empty(len(df), np.int32)
        self.number[common] = np.arange(len(df))
        posted, df = self.number[posted], df[common]
        a = np.bincount(posted, self.labels[example], len(self.hashes))
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((df - a + 0.5) / (n0 + 1))
        self.idf = (np.log((1 + n1 + n0) / (1 + df)) + 1) * np.abs(odds)
        counts = np.concatenate([n[k] for k in order]) if len(order) else np.empty(0)
        w = (1 + np.log(counts)) * self.idf[posted]
        norm = np.sqrt(np.bincount(example, w * w, len(order)))
        weights = (w / np.where(norm > 0, norm, 1)[example]).astype(np.float32)
        order = np.lexsort((example, posted))
        self.starts = np.concatenate([[0], np.cumsum(df)])
        self.postings = _packed(example[order], weights[order])
        self.ready = False

    def open(self) -> None:
        """The parts that follow from the postings, made once in each worker: block maxima, term maxima, the examples' own terms."""
        df = np.diff(self.starts)
        examples, weights = self.postings.view(POSTING)["of"], self.postings.view(POSTING)["weight"]
        posted = np.repeat(np.arange(len(df), dtype=np.int32), df)
        block = examples // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (posted[1:] != posted[:-1]) | (block[1:] != block[:-1])])) if len(posted) else np.empty(0, np.int64)
        self.block, self.block_max = block[first], np.maximum.reduceat(weights, first) if len(first) else weights
        self.block_starts = np.searchsorted(posted[first], np.arange(len(df) + 1))
        # the first terms, the commonest, are in most blocks: their maxima are rows of all blocks
        n_blocks = -(-len(self.ids) // BLOCK)
        few = np.flatnonzero(2 * np.diff(self.block_starts) < n_blocks)
        self.n_wide = int(few[0]) if len(few) else len(df)
        cut = self.block_starts[self.n_wide]
        self.wide = np.zeros((self.n_wide, n_blocks), np.float32)
        self.wide[posted[first[:cut]], self.block[:cut]] = self.block_max[:cut]
        self.top = np.maximum.reduceat(weights, self.starts[:-1]) if len(posted) else weights
        order = np.argsort(examples, kind="stable")
        self.own = _packed(posted[order], weights[order])
        self.own_starts = np.searchsorted(examples[order], np.arange(len(self.ids) + 1))
        self.query = np.zeros(len(df), np.float32)
        self.numbers: dict[bytes, int] = {}
        self.ready = True

    def numbered(self, at: np.ndarray) -> np.ndarray:
        """The numbers of hashed terms, -1 for those that no example holds."""
        if not len(self.hashes):
            return np.full(len(at), -1, np.int32)
        k = np.minimum(np.searchsorted(self.hashes, at), len(self.hashes) - 1)
        return np.where(self.hashes[k] == at, self.number[k], -1)

    def vector(self, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms that examples hold, ascending, and their weights at length 1; of numbered terms and their counts."""
        known = k >= 0
        k, n = k[known], n[known]
        order = np.argsort(k)
        k, n = k[order], n[order]
        w = (1 + np.log(n)) * self.idf[k]
        size = math.sqrt(float(w @ w))
        return k, w / size if size else w

    def vectors(self, texts: Iterable[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each whole text's vector."""
        found = list(map(words, texts))
        size = np.array([len(x) for x in found], np.int64)
        if len(self.numbers) > WORDS:
            self.numbers.clear()
        k = np.fromiter(map(self.numbers.get, chain.from_iterable(found), repeat(-2)), np.int32, size.sum())
        new = k == -2
        if new.any():
            unseen = [x for x, is_new in zip(chain.from_iterable(found), new.tolist(), strict=True) if is_new]
            k[new] = self.numbered(hashes(unseen, len(unseen)))
            self.numbers.update(zip(unseen, k[new].tolist(), strict=True))
        n = np.fromiter(chain.from_iterable(x.values() for x in found), np.int32, len(k))
        ends = np.cumsum(size)[:-1]
        return [self.vector(*x) for x in zip(np.split(k, ends), np.split(n, ends), strict=True)]

    def nearest(self, at: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosine over 0 (to 6 places; ties by number) and their cosines, exactly."""
        if not self.ready:
            self.open()
        return self._nearest(*self.vector(self.numbered(at), n), k)

    def _cosines(self, may: np.ndarray) -> np.ndarray:
        """The cosines of examples with self.query, from their own terms."""
        starts, ends = self.own_starts[may], self.own_starts[may + 1]
        own = _runs(self.own, starts, ends)
        return np.bincount(np.repeat(np.arange(len(may)), ends - starts), own["weight"] * self.query[own["of"]], len(may))

    def _nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of a vector.

        Terms are read by how much they can add for each of their postings. The block maxima of the terms left bound
        each example; once those that may still be among the nearest hold less than is left to read, they get their
        cosine from their own terms, those of the largest bounds first, as the least of these leaves out others.
        """
        self.query[t] = w
        bound, size = w * self.top[t], self.starts[t + 1] - self.starts[t]
        order = np.argsort(-bound / size, kind="stable")
        t, w, size = t[order], w[order], size[order]
        starts, ends = self.starts[t], self.starts[t + 1]
        rest = np.cumsum(bound[order][::-1])[::-1]
        read = np.concatenate([[0], np.cumsum(size)])
        score, done, step = np.zeros(len(self.ids)), 0, FIRST
        while True:
            stop = max(done + 1, int(np.searchsorted(read, read[done] + step, "right")) - 1) if done < len(t) else done
            part = slice(done, stop)
            got = _runs(self.postings, starts[part], ends[part])
            score += np.bincount(got["of"], got["weight"] * np.repeat(w[part], size[part]), len(score))
            done, step = stop, step * 4
            least = _least(score, k)
            if done < len(t) and step <= FIRST * 4 and rest[done] >= least:
                continue
            wide = t[done:] < self.n_wide
            more = w[done:][wide].astype(np.float32) @ self.wide[t[done:][wide]]
            part, by = t[done:][~wide], w[done:][~wide]
            n_blocks = self.block_starts[part + 1] - self.block_starts[part]
            of = _spread(self.block_starts[part], n_blocks)
            more = more + np.bincount(self.block[of], self.block_max[of] * np.repeat(by, n_blocks), len(more))
            reach = score + np.repeat(more, BLOCK)[: len(score)]
            may = np.flatnonzero((reach >= least) & (reach > 0))
            if done == len(t) or (self.own_starts[may + 1] - self.own_starts[may]).sum() <= read[-1] - read[done]:
                break
        if len(may) > 4 * k:
            by_reach = np.argpartition(-reach[may], 2 * k)
            may, others = may[by_reach[: 2 * k]], may[by_reach[2 * k :]]
            cos = self._cosines(may)
            others = others[reach[others] >= _least(cos, k)]
            may, cos = np.concatenate([may, others]), np.concatenate([cos, self._cosines(others)])
        else:
            cos = self._cosines(may)
        self.query[t] = 0
        cos = np.round(cos, 6)
        best = np.lexsort((may, -cos))[:k]
        best = best[cos[best] > 0]
        return may[best], cos[best]

    def vote(self, best: np.ndarray, cos: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The share of label 1 among the nearest, each weighing its cosine and the base rate PRIOR; and the evidence."""
        share = (float(cos @ self.labels[best]) + PRIOR * self.base) / (float(cos.sum()) + PRIOR)
        return min(1.0, max(0.0, share)), self.ids[best], cos

    def scores(self, texts: Iterable[str | None], k: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """The calibrated votes on texts, their neighbours and their cosines; without neighbours the base rate."""
        if not self.ready:
            self.open()
        texts = list(texts)
        for first in range(0, len(texts), TOGETHER):
            for vector in self.vectors(texts[first : first + TOGETHER]):
                share, ids, cos = self.vote(*self._nearest(*vector, k))
                if len(ids):
                    share = 1 / (1 + math.exp(-(self.slope * float(_logit(share)) + self.shift)))
                yield share, ids, cos


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def calibration(share: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from votes to probabilities; few rows keep it near the identity."""
    x, theta = np.stack([_logit(share), np.ones(len(share))], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ theta)))
        slope = x.T @ (p - label) + STEADY * (theta - (1.0, 0.0))
        curve = (x * (p * (1 - p))[:, None]).T @ x + STEADY * np.eye(2)
        theta = theta - np.linalg.solve(curve, slope)
    return max(float(theta[0]), 0.0), float(theta[1])


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, neighbours: int = NEIGHBOURS) -> NearestExamples:
    """The index over labelled, not held-out documents: a sample of at most max_examples, by hash of doc_id.

    A first index leaves out one in FOLDS of the examples; how its votes on these go with their labels gives the
    calibration. The index itself holds all examples.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_examples rows of two numbers
    # rows that repeat an id: the text with the smallest hash is its example
    one = joined.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            found = [tuple(x.tobytes() for x in terms(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "at": [f[0] for f in found], "n": [f[1] for f in found]}, index=pdf.index)

    rows = one.mapInPandas(counted, "doc_id long, toxic int, at binary, n binary")
    rows = saved(rows.withColumn("left", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)) == 0), "toxic-examples")
    given = rows.toArrow().to_pandas()  # the bounded sample
    given["toxic"] = given["toxic"] == 1

    def indexed(some: pd.DataFrame) -> NearestExamples:
        return NearestExamples(some["doc_id"].to_numpy(), some["toxic"].to_numpy(), [np.frombuffer(x, np.uint64) for x in some["at"]], [np.frombuffer(x, np.int32) for x in some["n"]])

    whole = indexed(given)
    first = docs.sparkSession.sparkContext.broadcast(indexed(given[~given["left"]]))

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shares = [first.value.vote(*first.value.nearest(np.frombuffer(at, np.uint64), np.frombuffer(n, np.int32), neighbours))[0] for at, n in zip(pdf["at"], pdf["n"], strict=True)]
            yield pd.DataFrame({"share": shares, "label": pdf["toxic"] == 1})

    left = rows.filter("left").repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInPandas(votes, "share double, label boolean").toPandas()
    first.destroy()
    if len(whole.ids):
        whole.slope, whole.shift = calibration(left["share"].to_numpy(float), left["label"].to_numpy(float))
    return whole


def score(docs: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence array<struct<doc_id, cosine>>) of every row of docs.

    Rows of labels (doc_id, toxic) whose crc32(doc_id) mod 5 is 0 are held out and never learnt from. A score is the
    cosine-weighted vote of the nearest examples, drawn towards the base rate by a small weight and calibrated on
    learnt rows that a first index left out; it comes from the whole text alone. predicted is 1 from 0.5 on. The
    evidence are the neighbours.

    Null and empty texts, and those without any term of the examples: the base rate. Null doc_id: scored,
    held_out null counted as false. Repeated rows: scored each; several labels of one id: toxic if one is. Without
    labels of both classes every score is the share of label 1 (of n + 1 labels, so 0 without labels). Other columns
    are ignored.
    """
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(fit(docs, labels, neighbours=neighbours))  # at most MAX_EXAMPLES examples

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = index.value
        for pdf in sliced(batches):
            found = list(model.scores(pdf["text"], neighbours))
            evidence = [[{"doc_id": int(i), "cosine": float(c)} for i, c in zip(ids, cos, strict=True)] for _, ids, cos in found]
            p = np.array([f[0] for f in found], float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": p, "predicted": (p >= 0.5).astype(int), "evidence": evidence}, index=pdf.index)

    scored = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,cosine:double>>")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The rows whose text isn't predicted toxic, columns as in docs; each row is judged by its own text, whatever its id."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, neighbours=neighbours))

    @pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([p < 0.5 for p, _, _ in index.value.scores(texts, neighbours)], dtype=bool)

    return docs.filter(clean(F.col("text")))
