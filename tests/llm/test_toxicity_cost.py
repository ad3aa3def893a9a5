"""Toxicity: the words of a text, exact ties, and how many postings a search reads."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from sieveworks.llm import toxicity


def index_of(texts: list[str]) -> toxicity.NearestExamples:
    found = [toxicity.terms(t) for t in texts]
    return toxicity.NearestExamples(np.arange(len(texts)), np.arange(len(texts)) % 4 == 0, [f[0] for f in found], [f[1] for f in found])


def drawn(seed: int) -> tuple[list[str], list[str]]:
    """Texts of 10 to 600 words, some much commoner than others, and queries; 50 of these are near to nothing."""
    rng = random.Random(seed)
    vocabulary, cum = [f"w{k}" for k in range(20_000)], np.cumsum(1 / np.arange(1, 20_001) ** 0.9).tolist()

    def draw(n: int) -> str:
        return " ".join(rng.choices(vocabulary, cum_weights=cum, k=n))

    texts = [draw(int(10 * 60 ** rng.random())) for _ in range(1200)]
    return texts, [draw(int(10 * 60 ** rng.random())) for _ in range(100)] + [draw(5) + " " + "w1 w2 w3 " * 2000 for _ in range(50)]


def test_words_are_those_of_the_pattern():
    odd = ["", None, "A_b c1 ÉCOLE—école “Straße” İstanbul ẋy", "a\x1cb\x85c d e​f", "中文,字 中文。字 ١٢٣ ²x é", "don't  --  \t\n\x0b\x0c\r 𝒳𝒴 🙂a🙂b", "é é— —é- éé"]
    rng = random.Random(5)
    odd += ["".join(rng.choice("aB_1 .-\n\x1fé—ßİ中。²́ 🙂") for _ in range(200)) for _ in range(200)]
    for text in odd:
        want = Counter(re.findall(r"\w+", (text or "").lower()))
        assert {w.decode(): n for w, n in toxicity.words(text).items()} == want
        at, n = toxicity.terms(text)
        assert len(at) == len(want) and (np.diff(at.astype(object)) > 0).all() and sorted(n.tolist()) == sorted(want.values())


def test_ties_to_six_places_go_by_number():
    texts, queries = drawn(2)
    index = index_of(texts)
    for text in queries:
        at, n = toxicity.terms(text)
        best, cos = index.nearest(at, n, 15)
        every, all_cos = index.nearest(at, n, len(texts))  # nothing is left out
        order = np.lexsort((every, -all_cos))[:15]
        assert best.tolist() == every[order].tolist() and cos.tolist() == all_cos[order].tolist()


def test_a_search_reads_few_postings(monkeypatch):
    texts, queries = drawn(2)
    index, read = index_of(texts), 0
    for name in ("_spread", "_runs"):
        if hasattr(toxicity, name):

            def counted(*args, of=getattr(toxicity, name)):
                nonlocal read
                found = of(*args)
                read += len(found)
                return found

            monkeypatch.setattr(toxicity, name, counted)
    for text in queries[:100]:
        index.nearest(*toxicity.terms(text), 15)
    assert read < 670_000  # 711,599 when terms were read by what they can add alone
