"""Lexical retrieval packing: windows filled from a BM25 index in shards of texts that share rare terms."""

from __future__ import annotations

import struct
import weakref
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import saved, sliced
from sieveworks.llm.tokens import load

#: Tokens of a shard: a task holds one shard's ids and index at a time.
SHARD_TOKENS = 1 << 18
#: A longer document is retrieved in pieces of so many windows.
PIECE_WINDOWS = 16
K1, B = 1.2, 0.75
#: Entries of each of the two generations of a Python worker's cache: of some 150 bytes, so under 100 MB a worker.
CACHE = 300_000
#: Characters of the longest key that is kept.
LONGEST = 100
#: Documents of a batch, whose distinct runs are looked up together.
BATCH_ROWS = 1000
#: Pieces that are added to a shard at once.
SLICE_ROWS = 32
END = 2


class Generations(dict):
    """What make() gives for a key, kept in two generations of CACHE entries, long keys excepted: what is in use stays."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds:
    """Ids of texts as little-endian unsigned 16-bit bytes.

    The tokenizer drops white space and no rule of it looks across, so a text's ids are those of its runs between
    spaces and line ends. It takes all in lower case and never joins a letter with a full stop or comma after it, so
    these may be split off first; a run of letters is one pre-token, which the model takes as it is.
    """

    def __init__(self, tokenizer):
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.bytewise = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        self.bytewise |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in self.bytewise)}
        run = weakref.WeakMethod(self.run)  # no cycle: the cache is freed with its owner, not when garbage is next collected
        self.runs = Generations(lambda text: run()(text))

    def word(self, lower: str) -> bytes:
        """A pre-token's ids; its bytes are written as the byte-level characters of the vocabulary."""
        mapped = lower if lower.isascii() else "".join(map(self.bytewise.__getitem__, lower.encode()))  # letters: ASCII ones are written as they are
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}H", *ids)

    def run(self, run: str) -> bytes:
        if run.isalpha() and (run.isascii() or max(run) <= "\u024f" and "\u0130" not in run):  # whose lower case is two letters
            return self.word(run.lower())
        return self.whole(run) if run else b""

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def of(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text of a batch: its distinct runs are looked up once, and spread over the texts by Arrow."""
        odd = pc.match_substring(texts, "<|")  # a special string may hold no space: the library looks for it in the whole text
        plain = pc.if_else(odd, "", texts)
        plain = pc.replace_substring(pc.ascii_lower(plain), "\n", " ")
        runs = pc.split_pattern(pc.replace_substring_regex(plain, "([a-z])([.,]) ", "\\1 \\2 "), " ")
        coded = runs.flatten().dictionary_encode()
        ids = list(map(self.runs.__getitem__, coded.dictionary.to_pylist()))
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 2)])
        values = pa.array(np.frombuffer(b"".join(ids), "<u2"), pa.uint16())
        spread = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values).take(coded.indices)
        flat, at = spread.flatten().to_numpy().tobytes(), np.concatenate([[0], np.cumsum(pc.list_value_length(spread).to_numpy())])
        at = at[np.concatenate([[0], np.cumsum(pc.list_value_length(runs).to_numpy())])] * 2
        out = [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self.whole(texts[k].as_py())
        return out


class Cached:
    """A tokenizer file's WordIds, made by the first task of a Python worker that asks for them.

    It is sent as a broadcast: a worker's tasks of one job share it, and it goes with the broadcast as soon as the
    worker gets a task of another. A cache of the module would stay beside all that the worker does later.
    """

    def __init__(self, path: str):
        self.path, self.ids = path, None

    def word_ids(self) -> WordIds:
        if self.ids is None:
            self.ids = WordIds(load(self.path))
        return self.ids


def token_pieces(docs: DataFrame, path: str, window: int, end: int = END) -> DataFrame:
    """(doc_id, start, doc_tokens, ids binary, t1 int, t2 int): documents' ids and the end id as unsigned 16-bit, in pieces of at most PIECE_WINDOWS windows.

    t1 and t2 are a piece's two largest ids: of a vocabulary in the order of its merges, the rarest.
    """
    most = PIECE_WINDOWS * window
    cached = docs.sparkSession.sparkContext.broadcast(Cached(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last = cached.value.word_ids(), np.array([end], "<u2").tobytes()
        for batch in (b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS)):
            out = []
            for i, data in zip(batch.column("doc_id").to_pylist(), cache.of(batch.column("text")), strict=True):
                data += last
                for k in range(0, len(data) // 2, most):
                    out.append((i, k, len(data) // 2, data[2 * k : 2 * (k + most)]))
            columns = [*zip(*out, strict=True)] if out else [()] * 4
            sizes = np.fromiter(map(len, columns[3]), np.int64, len(columns[3])) // 2
            columns += two_largest(np.frombuffer(b"".join(columns[3]), "<u2"), sizes)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "doc_tokens", "ids", "t1", "t2"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, start long, doc_tokens long, ids binary, t1 int, t2 int")


def distinct(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, id, how often) of each id that a piece holds, in this order: one sort for all pieces."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
    key = np.repeat(np.arange(len(pieces)) << 16, sizes) | flat
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first] >> 16, key[first] & 0xFFFF, np.diff(first, append=len(key))


def two_largest(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest id of each piece, none of them empty, and the largest below it (none: 0)."""
    at = np.cumsum(sizes) - sizes
    if not len(at):
        return at, at
    top = np.maximum.reduceat(flat, at)
    return top, np.maximum.reduceat(np.where(flat == np.repeat(top, sizes), 0, flat), at)


def statistics(pieces: DataFrame) -> tuple[np.ndarray, int, float]:
    """How many of all pieces hold each id (65,536 at most), how many pieces there are, and their mean length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, tokens = np.zeros(1 << 16, np.int64), 0, 0
        for pdf in sliced(batches):
            _, term, tf = distinct([np.frombuffer(ids, "<u2") for ids in pdf["ids"]])
            df += np.bincount(term, minlength=1 << 16)
            n, tokens = n + len(pdf), tokens + int(tf.sum())
        held = np.flatnonzero(df)
        yield pd.DataFrame({"id": [*held, -1, -2], "n": [*df[held], n, tokens]})

    rows = pieces.select("ids").mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << 16, np.int64)
    known = rows["id"] >= 0
    df[rows["id"][known]] = rows["n"][known]
    n, tokens = (int(rows["n"][rows["id"] == k].sum()) for k in (-1, -2))
    return df, n, tokens / max(n, 1)


class Index:
    """BM25 over the token ids of one shard's pieces; document frequencies and mean length are those of all pieces."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float):
        doc, term, tf = distinct(pieces)
        sizes = np.bincount(doc, minlength=len(pieces))
        norm = K1 * (1 - B + B * np.array([len(p) for p in pieces], float) / mean)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.n, self.ends, self.term = len(pieces), np.cumsum(sizes), term
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=1 << 16))])

    def neighbours(self, k: int, used: np.ndarray) -> np.ndarray:
        """Unused pieces that share a term with piece k, best first."""
        t = self.term[self.ends[k - 1] if k else 0 : self.ends[k]]
        size = self.first[t + 1] - self.first[t]
        at = np.arange(size.sum()) + np.repeat(self.first[t] - np.cumsum(size) + size, size)
        score = np.bincount(self.docs[at], self.weights[at], self.n)
        score[used] = 0
        at = np.flatnonzero(score)
        return at[np.argsort(-score[at], kind="stable")]


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def fill(pieces: list[np.ndarray], window: int, idf: np.ndarray, mean: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, from, to): every token once, all but the last few exactly `window` long.

    A seed's unused neighbours fill its window, best first; where they end, the next unused piece is another seed. A
    piece that is too long is cut and goes on in the next window as its seed. Pieces with equal ids don't meet in a
    window while others are left; the index knows them as one. What is left at the end becomes sequences of powers of two, which need no padding.
    """
    groups: dict[bytes, list[int]] = {}
    for k, p in enumerate(pieces):
        groups.setdefault(p.tobytes(), []).append(k)
    members = list(groups.values())
    group_of = {k: g for g, own in enumerate(members) for k in own}
    index, used = Index([pieces[own[0]] for own in members], idf, mean), np.zeros(len(members), bool)
    turns = deque(np.argsort([-len(pieces[own[0]]) for own in members], kind="stable").tolist())
    done: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    held: set[int] = set()  # groups in the open window
    room, carry, crowded = window, None, False  # crowded: all groups that are left are in it

    def place(k: int, at: int) -> None:
        nonlocal now, room, carry, crowded
        held.add(group_of[k])
        take = min(room, len(pieces[k]) - at)
        now.append((k, at, at + take))
        room -= take
        carry = (k, at + take) if at + take < len(pieces[k]) else None
        if not room:
            done.append(now)
            now, room, crowded = [], window, False
            held.clear()

    def one_of(g: int) -> int:
        k = members[g].pop()
        used[g] = not members[g]
        return k

    def next_seed() -> int | None:
        """A piece of the next group in turn that isn't in the window, or of any if all are."""
        nonlocal crowded
        for last in (False, True):
            for _ in range(len(turns)):
                g = turns.popleft()
                if used[g]:
                    continue
                turns.append(g)
                if last or crowded or g not in held:
                    return one_of(g)
            crowded = True
        return None

    while True:
        while carry is not None and carry[1] + window <= len(pieces[carry[0]]):
            place(*carry)
        if carry is not None:
            seed = carry[0]
            place(*carry)
        else:
            seed = next_seed()
            if seed is None:
                break
            place(seed, 0)
        if carry is None and now and not crowded:
            for g in index.neighbours(group_of[seed], used).tolist():
                if g not in held:
                    place(one_of(g), 0)
                    if not now or carry is not None:
                        break
    while now:
        size = 1 << (sum(b - a for _, a, b in now).bit_length() - 1)
        part = []
        while size:
            k, a, b = now.pop(0)
            take = min(size, b - a)
            part.append((k, a, a + take))
            size -= take
            if a + take < b:
                now.insert(0, (k, a + take, b))
        done.append(part)
    return done


def pack(docs: DataFrame, path: str, window: int = 4096, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Packs all rows of docs into sequences of at most `window` tokens; one row per piece of a document in a sequence.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids binary): ids as unsigned 16-bit
    little-endian, their CRC-32 as unsigned 32-bit; start and doc_tokens count the document's ids, the end id
    included; offsets in a sequence have no gap.

    Pieces are ordered by their two rarest ids, ties by a hash, and cut to shards of about shard_tokens: texts that
    share rare terms meet at any size of the table, and no source, length or group of copies makes a large shard.
    Each shard is one BM25 index, with the frequencies of all pieces, whose seeds take their unused neighbours by all
    their terms. A shard's sequences are full but for the last ones, whose lengths are powers of two.

    Null and empty texts: the end id alone. Null doc_id: packed like the rest. Repeated rows are packed each. An empty
    table gives an empty result; other columns are ignored.
    """
    pieces = token_pieces(docs, path, window, end)
    pieces = saved(pieces.withColumn("h", F.xxhash64("doc_id", "start", F.crc32("ids"))), "pieces")
    df, n, mean = statistics(pieces)
    shared = docs.sparkSession.sparkContext.broadcast((idf_of(df, n), mean))  # one number for each id of the vocabulary

    def packed(pdf: pd.DataFrame, first: int) -> pd.DataFrame:
        ids = [np.frombuffer(x, "<u2") for x in pdf["ids"]]
        doc, start, tokens = (pdf[c].to_numpy() for c in ("doc_id", "start", "doc_tokens"))
        out = []
        for number, sequence in enumerate(fill(ids, window, *shared.value)):
            offset = 0
            for k, a, b in sequence:
                part = ids[k][a:b]
                out.append((doc[k], start[k] + a, b - a, zlib.crc32(part.astype("<u4").tobytes()), tokens[k], first + number, offset, part.tobytes()))
                offset += b - a
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, first = [], 0, TaskContext.get().partitionId() << 40
        for pdf in sliced(batches, SLICE_ROWS):
            held.append(pdf)
            size += sum(map(len, pdf["ids"])) // 2
            if size >= shard_tokens:
                out = packed(pd.concat(held, ignore_index=True), first)
                first, held, size = int(out["sequence_id"].max()) + 1, [], 0
                yield out
        if size:
            yield packed(pd.concat(held, ignore_index=True), first)

    order = ["t1", "t2", "h"]
    dealt = pieces.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id", "start")
    return dealt.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
