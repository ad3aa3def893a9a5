"""Token counts from distinct pre-tokens, without token ids of documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import gathered, saved, sliced

#: The byte-level pre-tokenizer's pattern, with its white space spelt out (fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Characters whose class is the same in every Unicode version; a text with others is cut by the tokenizer itself.
COMMON = regex.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]*+")
#: Bytes of text that share one dictionary of pre-tokens.
BLOCK_BYTES = 32 << 20


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PreTokens:
    """Cuts texts into pre-tokens as the tokenizer does: special strings are single tokens, the rest follows PATTERN."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)

    def cut(self, text: str) -> list[str]:
        if COMMON.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def counted(self, text: str) -> tuple[Counter, int]:
        """The pre-tokens' counts and how many special strings stand between them."""
        if self.special is None or not self.special.search(text):
            return Counter(self.cut(text)), 0
        parts, found = self.special.split(text), Counter()
        for part in parts:
            found.update(self.cut(part))
        return found, len(parts) - 1


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays), 1)


def _unpack(data: bytes, *sizes: int) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zlib.decompress(data), np.uint8), 0, []
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out


def frequency_blocks(docs: DataFrame, path: str) -> DataFrame:
    """(block, words array<string>, doc_ids, n_bytes, special, sizes arrays, entries binary): per-document pre-token frequencies.

    A block is up to BLOCK_BYTES of consecutive texts of one task; entries are, document after document, the steps
    between the sorted places of its pre-tokens in words and their frequencies.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pre, number = PreTokens(path), TaskContext.get().partitionId() << 32
        place: dict[str, int] = {}
        ids, n_bytes, special, steps, counts = [], [], [], [], []

        def block() -> pd.DataFrame:
            nonlocal number
            number += 1
            sizes = [len(s) for s in steps]
            entries = _pack(np.concatenate(steps), np.concatenate(counts))
            out = pd.DataFrame({"block": [number], "words": [list(place)], "doc_ids": [list(ids)], "n_bytes": [list(n_bytes)], "special": [list(special)], "sizes": [sizes], "entries": [entries]})
            for x in (place, ids, n_bytes, special, steps, counts):
                x.clear()
            return out

        held = 0
        for pdf in sliced(batches):
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text or ""
                found, n = pre.counted(text)
                at = np.fromiter((place.setdefault(w, len(place)) for w in found), np.int64, len(found))
                order = np.argsort(at)
                ids.append(None if pd.isna(i) else int(i))
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                special.append(n)
                steps.append(np.diff(at[order], prepend=0))
                counts.append(np.fromiter(found.values(), np.int64, len(found))[order])
                held += n_bytes[-1]
                if held >= BLOCK_BYTES:
                    yield block()
                    held = 0
        if ids:
            yield block()

    schema = "block long, words array<string>, doc_ids array<long>, n_bytes array<long>, special array<long>, sizes array<int>, entries binary"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs, as the tokenizer file at `path` counts whole texts.

    No begin, end or added special tokens, no truncation or padding; special strings inside texts are one token each,
    as the library has it by default. Every distinct pre-token is tokenized once; its number of pieces is joined to
    the documents' pre-token frequencies, which travel in compressed blocks. n_bytes: UTF-8; over_limit: n_tokens > limit.

    Null and empty texts: 0 tokens. Null doc_id and repeated rows: one result row each. An empty table gives an empty
    result; other columns are ignored.
    """
    blocks = saved(frequency_blocks(docs, path), "token-blocks")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, last, n = load(path), None, 0
        for pdf in gathered(batches, 50_000):
            words = pdf["word"].tolist()
            new = list(dict.fromkeys(w for w in words if w != last))
            known = {w: len(tokenizer.encode(w, add_special_tokens=False)) for w in new}
            if last is not None:
                known.setdefault(last, n)
            if words:
                last, n = words[-1], known[words[-1]]
            out = pdf[["block", "pos"]].assign(n=[known[w] for w in words]).sort_values(["block", "pos"])
            for block, rows in out.groupby("block"):
                pos = rows["pos"].to_numpy()
                yield pd.DataFrame({"block": [block], "size": [len(rows)], "pieces": [_pack(np.diff(pos, prepend=0), rows["n"].to_numpy())]})

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n = np.zeros(row.n_words, np.int64)
                for part in row.parts if row.parts is not None else ():
                    step, k = _unpack(part["pieces"], part["size"], part["size"])
                    n[np.cumsum(step.astype(np.int64))] = k
                sizes = np.asarray(row.sizes, np.int64)
                step, count = _unpack(row.entries, int(sizes.sum()), int(sizes.sum()))
                # places restart with each document: a running sum less what it was before the document
                at = np.cumsum(step.astype(np.int64))
                ends = np.cumsum(sizes)
                at -= np.repeat(np.concatenate([[0], at])[ends - sizes], sizes)
                sums = np.concatenate([[0], np.cumsum(n[at] * count.astype(np.int64))])
                total = sums[ends] - sums[ends - sizes] + np.asarray(row.special, np.int64)
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in row.doc_ids], "Int64"), "n_bytes": row.n_bytes, "n_tokens": total, "over_limit": total > limit})

    words = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    counted = words.repartition("word").sortWithinPartitions("word")
    parts = saved(counted.mapInPandas(pieces, "block long, size int, pieces binary"), "token-pieces")
    parts = parts.groupBy("block").agg(F.collect_list(F.struct("size", "pieces")).alias("parts"))
    joined = blocks.withColumn("n_words", F.size("words")).drop("words").join(parts, "block", "left")
    result = joined.mapInPandas(totals, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    return saved(result, "token-counts")
