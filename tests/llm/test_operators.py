"""Each operator against a plain version of itself, on a small table with every awkward case."""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("sieveworks.llm.queries")

from sieveworks.llm import caps, chroma, mixing, packing, shingles, simhash, substring, suffix, tokens, toxicity, warc  # noqa: E402
from sieveworks.llm.common import components, n_words, saved  # noqa: E402
from sieveworks.llm.queries import tokenizer_path  # noqa: E402

RNG = random.Random(5)
WORDS = "the of river stone walks never quietly under bright caf\u00e9 na\u00efve harbour seven lights drift over cold plains \u0130stanbul 3.5 don't".split()


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.15 else "") for _ in range(n))


BASE = [prose(RNG.randrange(5, 120)) for _ in range(40)]
LONG = prose(6000)
TEXTS = [*BASE, BASE[0], BASE[0], BASE[1] + " tail", "x " + BASE[2], BASE[3] + "\n" + BASE[4], None, None, "", "   ", "a", "ab\t\r\n", "<|endoftext|> and <|startoftext|>x", "\u4e2d\u6587 \U0001f600!!", "a" * 300, "ab" * 300, LONG, LONG]
IDS = [7 * k + 3 for k in range(len(TEXTS))]
SOURCES = ["web"] * 30 + ["book"] * 15 + [None] * 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, SOURCES[k % len(SOURCES)], "en", len(t or ""), 1, 2) for k, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    rng = random.Random(1)
    rng.shuffle(rows)
    # columns with names that operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, n_removed int, size int").repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- 1: sentence spans


def test_substring(spark, docs):
    sentences, words, long = 2, 10, 14
    got = by_id(substring.dedup(docs, sentences, words, long))

    def cut(text):
        ends = [m.end() for m in re.finditer(r"[.!?]+\s+|\n\s*", text)]
        bounds = sorted({0, *ends, len(text)})
        return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    seen, marks = {}, {i: set() for i in IDS}
    for i, t in zip(IDS, TEXTS, strict=True):
        parts = cut(t or "")
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                found = "".join(parts[a:b]).split()
                if (b - a >= sentences and len(found) >= words) or (b == a + 1 and len(found) >= long):
                    key = " ".join(found)
                    if seen.setdefault(key, (i, a)) != (i, a):
                        marks[i] |= set(range(a, b))
                    break
    for i, t in zip(IDS, TEXTS, strict=True):
        parts = cut(t or "")
        want = None if t is None else "".join(p for k, p in enumerate(parts) if k not in marks[i])
        assert (got[i].text, got[i].n_removed) == (want, len(marks[i])), i
    assert any(marks.values())
    assert substring.dedup(docs.limit(0)).count() == 0
    assert substring.dedup(spark.createDataFrame([(None, "a b. c d."), (None, None)], "doc_id long, text string")).count() == 2


PASSAGE = ". ".join(" ".join(f"w{n}x{k}" for k in range(12)) for n in range(6)) + ". "


def test_substring_of_repeated_ids_and_odd_columns(spark):
    own = "Nothing of this is anywhere else at all, it stands alone. " * 1
    rows = [(1, PASSAGE, "a"), (1, PASSAGE, "b"), (1, own + "More words that are only here, and no others do come. ", "c"), (2, own[:0] + "Start of two. " + PASSAGE, "d"), (None, PASSAGE, "e"), (None, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans string").withColumns({c: F.col("_spans") for c in ("spans", "row", "cut", "h", "version", "n_removed")})
    got = {r["_spans"]: r for r in substring.dedup(df).collect()}
    assert len(got) == 6 and got["a"].text == got["b"].text == got["e"].text == PASSAGE and got["f"].text is None
    assert got["c"].text == rows[2][1] and got["d"].text == "Start of two. " and got["d"].spans == got["d"].version == "d" and got["d"].n_removed == 6


def test_substring_of_one_long_sentence_and_a_hot_span(spark):
    long = " ".join(f"u{k}" for k in range(60)) + ".\n"
    rows = [(k, f"Begin {k} {k * k}.\n{long}End of {k}, {k + 7}.") for k in range(1500)]
    got = by_id(substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got[0].n_removed == 0 and all(got[k].n_removed == 1 and got[k].text == f"Begin {k} {k * k}.\nEnd of {k}, {k + 7}." for k in range(1, 1500))


# ---- 2: packing


library = functools.cache(lambda name: tokens.load(tokenizer_path(name)))


def library_ids(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


def test_packing(docs):
    window = 256
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), window=window, shard_tokens=5_000).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in zip(IDS, TEXTS, strict=True):
        want, at = [*library_ids("word_bpe_49k.json", t), 2], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            ids = np.frombuffer(bytes(r.ids), "<u2")
            assert r.start == at and ids.tolist() == want[at : at + r.length] and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
            at += r.length
        assert at == len(want)
    total = padded = 0
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        n = sum(r.length for r in parts)
        assert n <= window
        total, padded = total + n, padded + (n if n & (n - 1) == 0 else window)
    assert padded <= 1.02 * total
    assert packing.pack(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_packing_takes_the_best_unused_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(k * 100, k * 100 + 40, 60).astype("<u2") for k in range(4) for _ in range(8)]
    flat = np.ones(1 << 16)
    done = packing.fill(topics, 480, flat, 60.0)
    inside = [len({k // 8 for k, _, _ in s}) for s in done if sum(b - a for _, a, b in s) == 480]
    assert inside == [1, 1, 1, 1]


def test_packing_ranks_by_plain_bm25_over_all_terms():
    rng = np.random.default_rng(1)
    pieces = [rng.zipf(1.3, rng.integers(20, 200)).clip(max=300).astype("<u2") for _ in range(80)]
    df = np.bincount(np.concatenate([np.unique(p) for p in pieces]), minlength=1 << 16)
    idf, mean = packing.idf_of(df, 80), float(np.mean([len(p) for p in pieces]))
    index, used = packing.Index(pieces, idf, mean), np.zeros(80, bool)
    used[[3, 9]] = True

    def bm25(query, piece):
        tf = Counter(piece.tolist())
        return sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(piece) / mean)) for t in set(query.tolist()) if t in tf)

    for k in (0, 40, 79):
        scores = {j: bm25(pieces[k], p) for j, p in enumerate(pieces) if j not in (3, 9)}
        got = index.neighbours(k, used).tolist()
        assert np.allclose([scores[j] for j in got], sorted((x for x in scores.values() if x > 0), reverse=True))


def test_packing_keeps_copies_apart_and_like_texts_together(spark):
    rng = random.Random(3)
    themes = [[f"{rng.choice('bcdfgklmprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmprst')}{rng.choice('aeiou')}x{t}q{k}" for k in range(30)] for t in range(12)]
    rows = [(k, " ".join(rng.choice(themes[k % 12]) for _ in range(60))) for k in range(480)]
    rows += [(1000, rows[0][1])] * 9
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("word_bpe_49k.json"), window=4096, shard_tokens=40_000).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r.doc_id)
    full = [s for s in sequences.values() if len(s) >= 6]
    assert sum(s.count(1000) > 1 for s in full) <= 1
    alike = [max(Counter(d % 12 for d in s if d < 1000).values()) / len(s) for s in full if any(d < 1000 for d in s)]
    assert np.mean(alike) > 0.3  # a twelfth if dealt at random


# ---- 3: token counts


def test_token_counts(docs):
    got = by_id(tokens.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), limit=50))
    for i, t in zip(IDS, TEXTS, strict=True):
        n = len(library_ids("byte_bpe_50k.json", t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 50), t
    assert tokens.count_tokens(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_token_counts_of_odd_texts(spark):
    pool = "a B 1 ' s ll  \t\n\r\u00a0\u2003\u3000. , ! \u00e9 \u4e2d \u0301 \u200b \U0001f600 <|endoftext|> <| _ - \x0b\x1c\x85".split(" ") + [" "]
    rng = random.Random(2)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(tokens.count_tokens(df, tokenizer_path("byte_bpe_50k.json")))
    assert [t for k, t in enumerate(texts) if got[k].n_tokens != len(library_ids("byte_bpe_50k.json", t))] == []


# ---- 4: SimHash


def plain_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    bits = [sum(xxhash.xxh64(s.encode(), seed=42).intdigest() >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs):
    got = by_id(simhash.near_duplicates(docs))
    prints = {i: plain_fingerprint(t, 4) for i, t in zip(IDS, TEXTS, strict=True)}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    near = [(a, b) for a in IDS for b in IDS if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in got.items()} == groups(IDS, near)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {IDS[40], IDS[41]}.isdisjoint(r.doc_id for r in kept.collect())


def test_keep_one_covers_similarity_of_four_fifths(spark):
    rng, rows = random.Random(8), []
    for k in range(60):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400)) for _ in range(300)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.sample(range(300), 1 + k % 9):
            words[at] = f"new{at}"
        rows.append((2 * k + 1, " ".join(words)))
    rows += [(1000, "one two"), (1001, "One  TWO"), (1002, "one three"), (None, rows[0][1]), (1003, None), (1004, " ")]

    def shingled(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = {i: shingled(t) for i, t in rows if i is not None}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    planted = [share[2 * k, 2 * k + 1] for k in range(60)]
    assert sum(0.8 <= s < 0.95 for s in planted) >= 30 and sum(s < 0.8 for s in planted) >= 10
    want = groups(sorted(sets), [p for p, s in share.items() if s >= 0.8])
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values())) and sum(r.doc_id is None for r in kept) == 1


def test_near_duplicates_compares_all_pairs_of_a_bucket(spark):
    rng = random.Random(5)
    rows, words = [], [f"w{k}" for k in range(200)]
    for k in range(120):  # a chain of texts: each like the last, the ends unlike
        words[rng.randrange(200)] = f"c{k}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(120), 0)
    assert shingles.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("exact", "large"), [(None, 1 << 14), (2, 1 << 14), (1, 20)])
def test_simhash_loses_no_link(spark, monkeypatch, exact, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in values[:100]:
        for bits in (1, 2, 3, 4, 5):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), bits)))
    for _ in range(200):  # a dense group, whose buckets are large
        values.append(values[0] ^ sum(1 << b for b in rng.sample(range(12), 3)))
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(set(values))]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), exact=exact).collect()
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    near = [(a, b) for a in signed for b in signed if a < b and bits(a, b) <= 4]
    assert groups(signed, [(r.a, r.b) for r in edges]) == groups(signed, near)


# ---- 5: suffix order


def plain_removed(texts, length):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        mark = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            part = data[k : k + length]
            if part in seen:
                mark[k : k + length] = True
            seen.add(part)
        runs = int(np.sum(mark[:-1] & ~np.concatenate([[False], mark[:-2]]))) if data else 0
        out.append((len(data), int(mark.sum()), runs, bytes(b for b, m in zip(data, mark, strict=False) if not m)))
    return out


@pytest.mark.parametrize("length", [100, 37])
def test_suffix(docs, length):
    got = by_id(suffix.dedup(docs, length))
    for i, want in zip(IDS, plain_removed(TEXTS, length), strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want, i
    assert suffix.dedup(docs.limit(0)).count() == 0


def test_suffix_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, "x" + PASSAGE), (3, "alone " * 3), (3, "other"), (None, PASSAGE), (None, None)], "doc_id long, text string")
    rows = suffix.dedup(df).collect()
    n = len(PASSAGE)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in rows) == [(0, 0, 0), (0, n, 0), (1, n, 0), (1, n, n), (2, n + 1, n), (3, 5, 0), (3, 18, 0)]
    two = spark.createDataFrame([(7, PASSAGE + "one"), (7, "two" + PASSAGE)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix.dedup(two).collect()) == [0, n]


def test_suffix_splits_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 40)
    monkeypatch.setattr(suffix, "PACKED", 4)
    rng, phrase = random.Random(31), "every text holds this phrase of over forty bytes "
    texts = [prose(12, rng) + phrase + prose(12, rng) for _ in range(150)]
    texts += [texts[k][20:] + str(k) for k in range(0, 150, 7)] + [phrase * 9, "a" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(suffix.dedup(df))
    for i, want in enumerate(plain_removed(texts, 100)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want, i


def test_previous_factors():
    data = b"abracadabra abracadabra"
    order = sorted(range(len(data)), key=lambda k: data[k:])
    same = lambda a, b: next((n for n in range(len(data)) if a + n >= len(data) or b + n >= len(data) or data[a + n] != data[b + n]), 0)
    lcp = [0, *(same(a, b) for a, b in zip(order, order[1:], strict=False))]
    got = suffix.previous_factors(np.array(order), np.array(lcp)).tolist()
    assert got == [max([0, *(same(k, j) for j in range(k))]) for k in range(len(data))]


# ---- 6: WARC


def test_warc(spark, tmp_path):
    pages = [(k, f"http://h{k % 3}.example/p{k}?q=a\n", None if k % 7 == 0 else f"<p>{'x' * (k % 5)}\u00e9" * (k % 4)) for k in range(60)] + [(100, None, "own"), (101, "not a url", "own")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    got = by_id(warc.round_trip(df, folder), "page_id")
    data = {i: (h or "").encode() for i, _, h in pages}
    for i, payload in data.items():
        best = max(j for j, p in data.items() if p == payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), digest, "response" if best == i else "revisit", None if best == i else best)
    assert len(got) == len(pages)
    archives = [p for p in (tmp_path / "w").rglob("*.warc.gz")]
    assert archives and all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\n") for p in archives)
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/w2").count() == 0


def test_warc_lookup(spark, tmp_path):
    # one url has captures in several blocks and parts; others share a block; two urls have one key
    pages = [(k, "http://hot.example/", f"copy {k}") for k in range(90)] + [(k, f"http://h{k % 4}.example/{k}", f"own {k}") for k in range(100, 160)]
    pages += [(200, "https://x.example:443/a", "s"), (201, "http://X.example/a#f", "t"), (202, None, "none"), (203, "tab\tin it", "odd"), (200, "http://h1.example/twice", "u")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    folder = f"file://{tmp_path}/w"
    captures = warc.write_archives(warc.with_revisits(df), f"{folder}/archive")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    try:
        directory = warc.write_index(captures, f"{folder}/index", block_lines=7)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert directory.count() > 1

    def found(*urls):
        asked = spark.createDataFrame([(u,) for u in urls], "url string")
        return sorted((r.page_id, bytes(r.payload).decode()) for r in warc.lookup(asked, directory, f"{folder}/index", f"{folder}/archive").collect())

    assert found("http://hot.example/", "http://hot.example/") == [(k, f"copy {k}") for k in range(90)]
    assert found("http://x.example/a") == [(200, "s"), (201, "t")] and found(None) == [(202, "none")] and found("tab\tin it") == [(203, "odd")]
    assert found("http://absent.example/", "a", "zzz", "http://h1.example/") == []
    everything = found(*(u for _, u, _ in pages))
    assert everything == sorted((i, h) for i, _, h in pages)
    assert warc.lookup(df.limit(0), directory, f"{folder}/index", f"{folder}/archive").count() == 0


def test_warc_keys():
    assert warc.url_key("http://WWW.a.example:80/p?q#f") == "example,a,www)/p?q" and warc.url_key(None) == ""


# ---- 7: spherical caps


def test_caps(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for centre in rng.normal(size=(40, 32)):
        for _ in range(6):
            rows.append((n, (centre + rng.normal(size=32) * 0.2).astype("f4").tolist(), int(n % 2) if n % 11 else None))
            n += 1
    rows += [(n, rows[2][1], 0), (n + 1, rows[2][1], 0), (n + 2, None, 0), (n + 3, [0.0] * 32, 0), (n + 4, [math.nan] * 32, 0), (n + 5, [], 0), (n + 6, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = by_id(caps.near_duplicates(df), "vec_id")
    vec = {i: caps.unit(v) for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    ids = list(vec)
    exact = [(a, b) for a in ids for b in ids if a < b and label[a] is not None and label[a] == label[b] and vec[a] is not None and vec[b] is not None and len(vec[a]) == len(vec[b]) and float(vec[a] @ vec[b]) >= 0.93]
    links = {i: sum(i in e for e in exact) for i in ids}
    assert all(got[i].n_links <= links[i] for i in ids)
    assert sum(got[i].n_links for i in ids) >= 0.9 * sum(links.values()) > 0
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert got[2].component_id == got[n].component_id == got[n + 1].component_id and all(got[n + k].n_links == 0 for k in range(2, 7))
    assert caps.near_duplicates(df.limit(0)).count() == 0


def exact_links(rows, threshold=0.93):
    vec = [caps.unit(v) for _, v, _ in rows]
    return [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][2] is not None and rows[a][2] == rows[b][2] and vec[a] is not None and vec[b] is not None and len(vec[a]) == len(vec[b]) and float(vec[a] @ vec[b]) >= threshold]


def test_caps_in_few_dimensions_and_with_repeated_ids(spark):
    rng = np.random.default_rng(5)
    for dim in (1, 2, 5):
        rows = [(k % 500, rng.normal(size=dim).tolist(), 1) for k in range(700)]
        got = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        links = Counter(k for pair in exact_links(rows) for k in pair)
        want = Counter((rows[k][0], links[k]) for k in range(700))
        have = Counter((r.vec_id, r.n_links) for r in got)
        assert sum(have.values()) == 700 and sum((have & want).values()) >= 0.9 * 700, dim
        assert sum(k[1] * n for k, n in have.items()) >= 0.95 * sum(links.values())


@pytest.mark.parametrize("dim", [32, 64, 384])
def test_caps_recall_just_above_the_threshold(spark, dim):
    rng = np.random.default_rng(dim)
    x, z = (rng.normal(size=(1500, dim)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.9301, 0.94, size=(1500, 1))
    rows = [(k, v, 3) for k, v in enumerate(np.concatenate([x, c * x + np.sqrt(1 - c * c) * z]).tolist())]
    got = by_id(caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id")
    assert sum(got[k].n_links >= 1 for k in range(1500)) >= 0.93 * 1500
    assert sum(r.n_links for r in got.values()) <= 2 * 1500 + 2


def test_caps_cuts_long_lists(spark, monkeypatch):
    monkeypatch.setattr(caps, "SPLIT", 20)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=48)
    rows = [(k, (centre + rng.normal(size=48) * (0.2 if k % 3 else 2.0)).tolist(), k % 2) for k in range(640)]
    got = by_id(caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id")
    links = exact_links(rows)
    n, comp = Counter(k for pair in links for k in pair), groups(range(640), links)
    assert all(got[k].n_links <= n[k] for k in range(640)) and sum(got[k].n_links for k in range(640)) >= 0.97 * sum(n.values())
    assert sum(got[k].component_id == comp[k] for k in range(640)) >= 630


# ---- 8: toxicity


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(1500):
        toxic = int(k % 5 == 0)
        text = prose(40, rng) + (" " + " ".join(rng.choice(["vilescum", "hatefool", "trashidiot"]) for _ in range(6)) if toxic else "")
        rows.append((k, text, "web"))
        labels.append((k, toxic))
    rows += [(9001, None, None), (9002, "", None)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.score(df, marks))
    held = {k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0}
    assert {k for k, r in got.items() if r.held_out} >= held
    right = [got[k].predicted == y for k, y in labels if k in held]
    assert sum(right) >= 0.98 * len(right)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and got[9001].predicted == 0
    assert not {e.doc_id for r in got.values() for e in r.evidence or ()} & held
    kept = toxicity.drop_toxic(df, marks)
    assert kept.columns == df.columns and 1150 <= kept.count() <= 1250
    twice = df.filter("doc_id = 0").union(df.filter("doc_id = 1").withColumn("doc_id", F.lit(0)))  # one id, a toxic and a clean text
    assert [r.text for r in toxicity.drop_toxic(df.union(twice), marks).filter("doc_id = 0").collect()] == [rows[1][1]]
    assert toxicity.score(df, marks.limit(0)).filter("score != 0").count() == 0


def test_toxicity_finds_the_nearest_examples_exactly(monkeypatch):
    monkeypatch.setattr(toxicity, "FIRST", 50)
    rng = random.Random(17)
    texts = [prose(rng.randrange(3, 60), rng) + "".join(f" rare{rng.randrange(300)}" for _ in range(rng.randrange(6))) for _ in range(900)]
    labels = np.array([rng.random() < 0.3 for _ in texts])
    found = [toxicity.terms(t) for t in texts]
    index = toxicity.NearestExamples(np.arange(900), labels, [f[0] for f in found], [f[1] for f in found])
    words = [Counter(re.findall(r"\w+", t.lower())) for t in texts]
    df, a = Counter(w for c in words for w in c), Counter(w for c, y in zip(words, labels, strict=True) if y for w in c)
    n1, n0 = int(labels.sum()), int((~labels).sum())
    weight = {w: (math.log(901 / (1 + n)) + 1) * abs(math.log((a[w] + 0.5) / (n1 + 1)) - math.log((n - a[w] + 0.5) / (n0 + 1))) for w, n in df.items()}

    def vector(c):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in c.items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / size for w, x in v.items()}

    vectors = [vector(c) for c in words]
    for text in [*texts[:20], prose(50, rng) + " rare7 rare7 unknown", "unknown", ""]:
        q = vector(Counter(re.findall(r"\w+", text.lower())))
        cos = sorted((sum(x * v.get(w, 0) for w, x in q.items()) for v in vectors), reverse=True)[:15]
        ids, got = index.nearest(*toxicity.terms(text), 15)
        want = [c for c in cos if c > 5e-7]
        assert len(got) == len(want) and np.allclose(got, want, atol=2e-6)
        numbers = index.ids[ids]
        assert np.allclose([sum(x * vectors[i].get(w, 0) for w, x in q.items()) for i in numbers], got, atol=2e-6)


def test_toxicity_keeps_rare_words_and_few_labels(spark):
    rng = random.Random(21)
    free = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 5]
    for n, n_toxic in ((12, 3), (20, 10), (240, 24)):
        ids, rows = free[: n + 2], []
        for k, i in enumerate(ids):
            word = " rareslur" if k < 2 or k == n else " vilescum" if k < n_toxic else ""
            rows.append((i, prose(30, rng) + word))
        labels = [(i, int(k < n_toxic)) for k, i in enumerate(ids[:n])]
        df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
        got = by_id(toxicity.score(df, marks))
        assert got[ids[n]].score > got[ids[n + 1]].score and {e.doc_id for e in got[ids[n]].evidence[:2]} == set(ids[:2])
        assert sorted(toxicity.fit(df, marks).ids.tolist()) == sorted(ids[:n])


def test_toxicity_with_balanced_labels_leaves_clean_texts_alone(spark):
    rng = random.Random(22)
    free = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 5][:120]
    marked = {i: k % 2 for k, i in enumerate(free)}
    rows = [(i, prose(40, rng) + (" hatefool trashidiot" if y else "")) for i, y in marked.items()] + [(500, None), (501, "unheard words alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(list(marked.items()), "doc_id long, toxic int")
    got = by_id(toxicity.score(df, marks))
    assert [i for i, y in marked.items() if got[i].predicted != y] == [] and got[500].predicted == got[501].predicted == 0
    one = toxicity.score(df.union(df.limit(3)), marks.filter("toxic = 1")).filter("predicted = 0").count()
    assert one == 0


# ---- 9: chroma


def test_chroma(spark):
    rng = np.random.default_rng(9)
    tune = rng.normal(size=64).astype("f4")
    vectors = [(0, tune.tolist()), (1, (tune + rng.normal(size=64) * 0.01).astype("f4").tolist()), *((k, rng.normal(size=64).astype("f4").tolist()) for k in range(2, 12)), (50, tune.tolist()), (51, None), (52, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = by_id(chroma.search(chroma.melodies(df)), "rec_id")
    found = {m.rec_id for m in got[0].matches}
    assert {1, 50} <= found and found <= {1, 50} and got[0].is_query and got[2].matches is None
    assert all(m.errors <= 0.2 for m in got[0].matches) and (got[51].n_ints or 0) == 0
    assert chroma.search(chroma.melodies(df.limit(0))).count() == 0


def test_chroma_survives_noise():
    rng = np.random.default_rng(1)
    t = np.arange(chroma.RATE * 8) / chroma.RATE
    song = np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (rng.integers(-12, 12) / 12) * t[: chroma.RATE // 2]) for _ in range(16)])
    a = chroma.fingerprint(chroma.chroma(song, chroma.RATE))
    b = chroma.fingerprint(chroma.chroma(song + rng.normal(size=len(song)) * 0.01, chroma.RATE))
    n = min(len(a), len(b))
    wrong = np.unpackbits((a[:n] ^ b[:n]).astype("<u4").view("u1")).mean()
    assert n > 20 and wrong < 0.1


def test_chroma_finds_alignments_with_bit_errors(spark):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    base = rng.integers(0, 1 << 32, size=(30, 50), dtype=np.uint64)
    for k, fp in enumerate(base):
        rows.append((k, fp.astype(np.int64).tolist()))
    for n, share in enumerate((0.0, 0.05, 0.1)):
        for k, fp in enumerate(base):
            at = int(rng.integers(0, 15))
            wrong = rng.random((50 - at, 32)) < share
            noisy = fp[at:] ^ (wrong * (1 << np.arange(32, dtype=np.uint64))).sum(axis=1).astype(np.uint64)
            rows.append((100 * (n + 1) + k, noisy.astype(np.int64).tolist()))
            want[100 * (n + 1) + k] = (k, -at)
    rows += [(900, [7]), (901, [7]), (902, []), (903, [5] * 40), (904, [5] * 40)]
    prints = spark.createDataFrame(rows, "rec_id long, fp array<long>")
    got = {(r.query_id, r.rec_id): r.offset for r in chroma.align(prints, prints.filter("rec_id < 30 or rec_id > 899")).collect()}
    fps = {i: np.array(v, np.uint64) for i, v in rows}

    def errors(a, b, offset):  # of two recordings with b's positions offset from a's
        first = max(0, -offset)
        n = min(len(a) - first, len(b) - first - offset)
        return np.bitwise_count(a[first : first + n] ^ b[first + offset : first + offset + n]).sum() / (32 * n) if n > 0 else 1.0

    for n in (1, 2, 3):  # recall against the brute-force alignment
        pairs = [(k, i, o) for i, (k, o) in want.items() if i // 100 == n and min((errors(fps[k], fps[i], x), x) for x in range(-49, len(fps[i])))[1] == o]
        assert len(pairs) >= 28 and sum(got.get((k, i)) == o for k, i, o in pairs) >= 0.9 * len(pairs)
    assert got[900, 901] == got[901, 900] == 0 and got[903, 904] == 0
    assert all(errors(fps[a], fps[b], o) <= 0.2 for (a, b), o in got.items())


def test_chroma_alignments_do_not_depend_on_the_size_of_the_table(spark):
    """Pairs with 15 in 100 bits wrong, and short recordings, align alike alone and among recordings of 2^21 positions."""
    rng = np.random.default_rng(21)
    base = rng.integers(0, 1 << 32, size=(40, 50), dtype=np.uint64)
    noisy = base ^ ((rng.random((40, 50, 32)) < 0.15) * (1 << np.arange(32, dtype=np.uint64))).sum(axis=2).astype(np.uint64)
    rows = [*((k, fp.astype(np.int64).tolist()) for k, fp in enumerate(base)), *((100 + k, fp.astype(np.int64).tolist()) for k, fp in enumerate(noisy))]
    rows += [(40, base[3, 10:18].astype(np.int64).tolist()), (41, [9, 8, 7]), (200, [1, 2, *base[5, :6].astype(np.int64).tolist(), 9, 8, 7] * 3)]
    few = spark.createDataFrame(rows, "rec_id long, fp array<long>")
    many = few.union(spark.range(1000, 42_000).selectExpr("id", "transform(sequence(1, 50), x -> xxhash64(id, x) & 4294967295L)"))
    got = [{(r.query_id, r.rec_id, r.offset, r.votes) for r in chroma.align(x, few.filter("rec_id < 50")).collect() if r.rec_id < 1000} for x in (few, many)]
    assert got[0] == got[1] and {(40, 3, 10), (3, 40, -10)} <= {x[:3] for x in got[0]} and (41, 200) in {x[:2] for x in got[0]}


@pytest.mark.parametrize("power", (13, 20, 25, 30, 36, 40, 44, 48))
def test_chroma_recall_at_any_size_of_the_table(power):
    """Overlaps of 50 integers with a tenth of their bits wrong have three right keys, however long keys are."""
    masks, rng, found = chroma.key_masks(1 << power), np.random.default_rng(power), 0
    (bits,) = {m.bit_count() for m in masks}
    assert len(set(masks)) == len(masks) and bits >= max(20, min(48, power + 1))
    for _ in range(600):
        wrong = ((rng.random((50, 32)) < chroma.BORNE) * (1 << np.arange(32, dtype=np.uint64))).sum(axis=1).astype(np.uint64)
        pair = wrong[:-1] << np.uint64(32) | wrong[1:]
        found += sum(int(((pair & np.uint64(m)) == 0).sum()) for m in masks) >= 3
    assert found >= 0.9 * 600
    assert len(masks) <= 64 and (power > 13 or len(masks) == chroma.LEAST_KEYS)


def test_chroma_frames_take_as_long_at_any_rate():
    rng = np.random.default_rng(2)
    notes = rng.integers(-12, 12, 24)

    def song(rate):
        t = np.arange(rate // 4) / rate
        return np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) for k in notes]).astype(np.float32)

    a, b = (chroma.fingerprint(chroma.chroma(song(rate), rate)) for rate in (8000, 11025))
    n = min(len(a), len(b))
    assert abs(len(a) - len(b)) <= 1 and np.unpackbits((a[:n] ^ b[:n]).astype("<u4").view("u1")).mean() < 0.1


# ---- 10: mixing


def test_mixing(spark, docs):
    got = mixing.mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(IDS, TEXTS, strict=True)}
    assert {r.doc_id: r.size for r in got} == sizes
    assert all(r.taken == r.copies * r.size and r.taken <= 2 * r.size for r in got)
    names = ["book", "web", None]
    weight = dict(zip(names, (5.0, 2.0, 1.0), strict=True))
    size = {s: sum(r.size for r in got if r.source == s) for s in names} if "source" in got[0] else None
    if size is None:
        source = {i: SOURCES[k % len(SOURCES)] for k, i in enumerate(IDS)}
        size = {s: sum(sizes[i] for i in IDS if source[i] == s) for s in names}
    else:
        source = {r.doc_id: r.source for r in got}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    largest = max(sizes.values())
    for s in names:
        own = [r for r in got if source[r.doc_id] == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= largest
    again = mixing.mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_mixing_keeps_columns_and_rows(spark):
    rng = random.Random(40)
    rows = [(None if k % 3 == 0 else k % 200, " ".join("w" * rng.randrange(0, 30)), rng.choice(["a", "b", None]), k) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, number long").withColumns({c: F.col("number") for c in ("_h", "row", "rank", "range", "h", "first", "a.b", "copies", "tie")})
    mixed = mixing.mix(df)
    got = mixed.collect()
    assert len(got) == 900 and all(r["_h"] == r["row"] == r["range"] == r["a.b"] == r["tie"] == r.number for r in got)
    assert {(r.doc_id, r.text, r.number) for r in got} == {(a, b, n) for a, b, _, n in rows}
    assert mixing.emit(mixed).groupBy("number").count().count() == sum(r.copies > 0 for r in got) and mixing.emit(mixed).count() == sum(r.copies for r in got)
    for s in ("a", "b", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 30
    drawn = lambda rows: Counter((r.doc_id, r.text, r.source, r.copies) for r in rows)
    assert drawn(mixing.mix(df.repartition(7)).collect()) == drawn(got)
    assert mixing.mix(df.limit(0)).count() == 0


# ---- shared parts


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == groups({x for e in real for x in e}, real)


def test_saved_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    assert saved(df, "t").schema == df.schema and saved(df, "t").count() == 2


