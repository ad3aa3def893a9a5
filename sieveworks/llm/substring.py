"""Substring deduplication over sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from sieveworks.llm.common import bounded_batches, sliced

#: A sentence ends after its mark and white space, or at a line end.
ENDS = re.compile(r"[.!?]+\s+|\n\s*")
#: A span is the shortest run from a sentence on that has so many sentences and words, or one sentence of so many words.
SPAN_SENTENCES = 2
SPAN_WORDS = 20
LONG_SENTENCE = 40
CUT = T.StructType().add("text", "string").add("sentences", "long").add("removed", "long")


def sentence_bounds(text: str) -> list[int]:
    """0, the end of each sentence with the space after it, and the text's length: consecutive bounds cut the text without loss."""
    bounds = [0, *(m.end() for m in ENDS.finditer(text))]
    if bounds[-1] < len(text):
        bounds.append(len(text))
    return bounds


def spans(text: str, sentences: int, words: int, long: int) -> tuple[list[int], list[int], list[int]]:
    """(first sentence, one past the last, XXH64) of the span that begins at each sentence; the last ones may have none."""
    b = sentence_bounds(text)
    parts = [text[x:y].split() for x, y in zip(b, b[1:], strict=False)]
    n = len(parts)
    total = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
    joined = [" ".join(p) for p in parts]
    first, end, hashes, reach = [], [], [], 0
    for i in range(n):
        reach = max(reach, i + sentences)
        while reach <= n and total[reach] - total[i] < words:
            reach += 1
        j = i + 1 if len(parts[i]) >= long else reach
        if j > n:
            continue
        first.append(i)
        end.append(j)
        hashes.append(xxhash.xxh64_intdigest(" ".join(joined[i:j]).encode("utf-8", "surrogatepass")))
    return first, end, hashes


def span_table(docs: DataFrame, sentences: int, words: int, long: int) -> DataFrame:
    """(h, doc_id, version, first int, size int, known): every span of every document; version tells texts of one doc_id apart.

    known marks a span that also begins earlier among the rows that its task handles at once: it is a later copy
    whatever the other tasks hold, so its h only spreads such rows. Of a span that very many documents share, little
    more than one row for each of these parts meets the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            pdf = pdf.sort_values(["doc_id", "version"])
            found = [spans(t, sentences, words, long) for t in pdf["text"]]
            first, end, h = (np.fromiter((x for f in found for x in f[k]), t) for k, t in ((0, np.int32), (1, np.int32), (2, np.uint64)))
            sizes = [len(f[0]) for f in found]
            ids, version = (np.repeat(pdf[c].to_numpy(), sizes) for c in ("doc_id", "version"))
            out = pd.DataFrame({"h": h.view(np.int64), "doc_id": ids, "version": version, "first": first, "size": end - first})
            out = out.drop_duplicates(["doc_id", "version", "first"])  # equal rows are one document
            out["known"] = out.duplicated("h")
            out.loc[out["known"], "h"] = (out["doc_id"] * 31 + out["first"])[out["known"]]
            yield out

    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")
    return rows.mapInPandas(run, "h long, doc_id long, version long, first int, size int, known boolean")


def repeated(docs: DataFrame, sentences: int = SPAN_SENTENCES, words: int = SPAN_WORDS, long: int = LONG_SENTENCE) -> DataFrame:
    """(doc_id, version, spans array<struct<first, size>>): the spans of each document that also begin earlier.

    First is the smallest (doc_id, version, first sentence). Spans are shuffled once, by their hash.
    """
    table = span_table(docs, sentences, words, long)
    order = Window.partitionBy("h", "known").orderBy("doc_id", "version", "first")
    at = F.struct("doc_id", "version", "first")
    # a document that two tasks hold as equal rows has its spans twice: only what begins elsewhere is a copy
    later = table.withColumn("least", F.first(at).over(order)).filter(F.col("known") | (at > F.col("least")))
    return later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "size")).alias("spans"))


@pandas_udf(CUT)
def without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Each text without the sentences of its spans, how many it had and how many went."""
    out = []
    for text, found in zip(texts, spans, strict=True):
        b = sentence_bounds(text) if text is not None else [0]
        drop = np.zeros(len(b) - 1, bool)
        if found is not None:
            for x in found:
                drop[x["first"] : x["first"] + x["size"]] = True
            text = "".join(text[x:y] for x, y, d in zip(b, b[1:], drop, strict=False) if not d)
        out.append((text, len(drop), int(drop.sum())))
    return pd.DataFrame(out, columns=["text", "sentences", "removed"])


def dedup(docs: DataFrame, sentences: int = SPAN_SENTENCES, words: int = SPAN_WORDS, long: int = LONG_SENTENCE) -> DataFrame:
    """docs with the sentences removed that a non-first repeated span covers, and n_sentences, n_removed.

    Sentences end at ``.!?`` before white space and at line ends. From each sentence on, the span is the shortest run
    of at least `sentences` sentences and `words` words, or the sentence alone if it has `long` words; spans are equal
    when their words are. Every removal is judged on the input. A kept text is the remaining sentences in order with
    the space that follows each.

    Spans are ordered by doc_id, then by text (64-bit hash), then by place. Equal rows are one document and treated
    alike; different texts of one doc_id are documents of their own. Null doc_id: kept as it is, its spans not
    compared. Null text stays null with 0 sentences; an empty table gives an empty result. Other columns are kept,
    whatever their names, but those named n_sentences or n_removed are replaced.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), "doc_id", F.xxhash64("text").alias("version"))
    found = repeated(docs.select("doc_id", "text"), sentences, words, long).select(F.col("doc_id").alias("of"), F.col("version").alias("of_version"), "spans")
    joined = rows.join(found, (F.col("doc_id") == F.col("of")) & (F.col("version") == F.col("of_version")), "left")
    cut = joined.select("row", without(F.col("row.text"), F.col("spans")).alias("cut"))
    kept = (F.col("cut.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in rest)
    return cut.select(*kept, F.col("cut.sentences").alias("n_sentences"), F.col("cut.removed").alias("n_removed"))
