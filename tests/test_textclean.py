from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import codepoints as cps
from sieveworks.operators import textclean
from sieveworks.operators.textclean import TextOptions

AGGRESSIVE, NO_SPACES = TextOptions(aggressive_homoglyphs=True), TextOptions(normalize_spaces=False)
BIDI, GLUE = TextOptions(strip_bidi=True), TextOptions(strip_emoji_glue=True)
DEFAULT = TextOptions()

VECTORS = [
    (DEFAULT, "Hello\u200bWorld", "HelloWorld"),
    (DEFAULT, "a\u200c\u200db", "ab"),
    (DEFAULT, "x\ufeffy\u00adz", "xyz"),
    (DEFAULT, "a\u00a0b\u2009c\u3000d", "a b c d"),
    (NO_SPACES, "a\u00a0b", "a\u00a0b"),
    (DEFAULT, "a\u200eb\u200fc", "a\u200eb\u200fc"),
    (DEFAULT, "a\u202eb\u202ac", "abc"),
    (DEFAULT, "a\u202ab\u202cc", "a\u202ab\u202cc"),
    (DEFAULT, "a\u202eb\u202cc", "abc"),
    (DEFAULT, "\u202c\u202a\u202e\u202c\u202c\u202c", "\u202a\u202c"),
    (BIDI, "a\u200eb", "ab"),
    (BIDI, "a\u202ab\u202cc", "abc"),
    (DEFAULT, "a\U000e0001b\U000e0020c", "abc"),
    (DEFAULT, "\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f", None),
    (DEFAULT, "\U0001f3f4\U000e0067x", "\U0001f3f4x"),
    (DEFAULT, "\U0001f468\u200d\U0001f469\u200d\U0001f467", None),
    (DEFAULT, "\u2764\ufe0f\u200d\U0001f525", None),
    (DEFAULT, "\u2696\ufe0f", None),
    (DEFAULT, "1\ufe0f", None),
    (DEFAULT, "\u4e2d\U000e0100", None),
    (DEFAULT, "\u1820\u180b", None),
    (DEFAULT, "a\u180bb", "ab"),
    (DEFAULT, "\u0645\u06cc\u200c\u0631\u0648\u0645", None),
    (DEFAULT, "\u1780\u200b\u17b4x\u17b4", "\u1780\u17b4x"),
    (DEFAULT, "\u1100\u1160a\u1160", "\u1100\u1160a"),
    (DEFAULT, "\U00013000\U00013430 \U00013430", "\U00013000\U00013430 "),
    (DEFAULT, "\u0600a\u0890", "\u0600a"),
    (GLUE, "\u0600a", "a"),
    (DEFAULT, "a\ue000b\ufdd0c\u2065d\uffff", "abcd"),
    (DEFAULT, "\u0410BC\uff21", None),
    (AGGRESSIVE, "\u0410BC\uff21\uff5a", "ABCAz"),
    (GLUE, "\U0001f468\u200d\U0001f469", "\U0001f468\U0001f469"),
    (DEFAULT, "", ""),
    (DEFAULT, "plain\r\n\ttext", None),
]


def cleaned(spark, texts, options):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: r for r in textclean.clean(df, "id", "text", options).collect()}


@pytest.mark.parametrize("options", sorted({v[0] for v in VECTORS}, key=repr), ids=repr)
def test_vectors(spark, options):
    own = [v for v in VECTORS if v[0] == options]
    found = cleaned(spark, [v[1] for v in own], options)
    assert {k: r.clean for k, r in found.items()} == {k: v[1] if v[2] is None else v[2] for k, v in enumerate(own)}
    assert all(r.bytes_in == len(own[k][1].encode()) and r.bytes_out == len(r.clean.encode()) for k, r in found.items())


def is_in(cp, parts):
    return any(lo <= cp <= hi for lo, hi in parts)


def brute(text, options):
    """The rules one code point after the other."""
    chars = [ord(c) for c in text]
    paired, stack, flags = set(), [], set()
    for i, c in enumerate(chars):
        if is_in(c, cps.BIDI_OPEN):
            stack.append(i)
        elif c == cps.BIDI_POP and stack:
            o = stack.pop()
            paired |= {o, i} if is_in(chars[o], cps.BIDI_EMBED) else set()
        if c == cps.WAVING_BLACK_FLAG:
            j = i + 1
            while j < len(chars) and 0xE0020 <= chars[j] <= 0xE007E:
                j += 1
            if j > i + 1 and j < len(chars) and chars[j] == 0xE007F:
                flags |= set(range(i, j + 1))
    out, kinds, base = [], [], -1

    def script(c):
        return next((k for k, s in enumerate(cps.JOINING_SCRIPTS, 1) if is_in(c, s)), 0)

    for i, c in enumerate(chars):
        before, after = chars[i - 1] if i else -1, chars[i + 1] if i + 1 < len(chars) else -1
        keep = not options.strip_bidi and (i in paired or is_in(c, cps.BIDI_KEPT))
        if not options.strip_emoji_glue:
            keep |= is_in(c, cps.VS_SUPPLEMENT + cps.TEXT_SELECTOR) and is_in(before, cps.CJK)
            keep |= is_in(c, cps.MONGOLIAN_FVS) and (is_in(before, cps.MONGOLIAN_BASE) or is_in(base, cps.MONGOLIAN_LETTER))
            keep |= is_in(c, cps.EMOJI_SELECTOR) and is_in(before, cps.EMOJI_BASE)
            keep |= c == 0x200D and is_in(base, cps.EMOJI_BASE) and is_in(after, cps.EMOJI_BASE)
            keep |= is_in(c, cps.JOINER) and 0 != script(before) == script(after)
            keep |= is_in(c, cps.TAG_RANGE) and i in flags
            keep |= is_in(c, cps.KHMER_VOWEL) and is_in(base, cps.KHMER_LETTER)
            keep |= is_in(c, cps.HANGUL_FILLER) and is_in(base, cps.HANGUL_JAMO)
            keep |= is_in(c, cps.ORTHOGRAPHIC)
            keep |= any(is_in(c, x) and (is_in(before, s) or is_in(after, s)) for x, s in cps.LAYOUT_NEAR)
        new = chr(c)
        if not keep:
            if is_in(c, cps.STRIPPED):
                new = ""
            elif options.normalize_spaces and is_in(c, cps.EXOTIC_SPACE):
                new = " "
            elif options.aggressive_homoglyphs and is_in(c, cps.CONFUSABLE):
                new = dict(cps.CYRILLIC_LATIN).get(c) or chr(c - 0xFEE0)
            elif is_in(c, cps.FORMAT):
                new = ""
        out.append(new)
        if new != chr(c):
            kinds.append(i)
        if new and not (is_in(c, cps.GLUE) and new == chr(c)):
            base = ord(new)
    return "".join(out), len(kinds)


@pytest.mark.parametrize("options", [DEFAULT, TextOptions(aggressive_homoglyphs=True, strip_bidi=True), GLUE, NO_SPACES], ids=repr)
def test_random_texts_equal_one_by_one_rules(spark, options):
    pool = [0x61, 0x31, 0x4E2D, 0x1820, 0x180B, 0x180F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x200D, 0x200C, 0xFE0F, 0xFE01, 0x1F468, 0x1F3F4, 0xE0067, 0xE007F, 0xE0001,
            0x645, 0x631, 0x17B4, 0x1780, 0x1160, 0x1100, 0x600, 0x890, 0x13430, 0x13000, 0x13439, 0xA0, 0x410, 0xFF21, 0xE000, 0x200B, 0x2066, 0x20, 0x0A]
    rng = random.Random(7)
    texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    found = cleaned(spark, texts, options)
    assert {k: (r.clean, r.n_dropped) for k, r in found.items()} == {k: brute(t, options) for k, t in enumerate(texts)}


def test_nulls_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a\u200bb", None)], "id long, text string, pos long")
    rows = {r.id: r for r in textclean.clean(df, "id", "text").collect()}
    assert (rows[1].clean, rows[1].bytes_out, rows[1].n_dropped) == (None, None, 0)
    assert (rows[2].clean, rows[2].n_dropped) == ("ab", 1)
    assert textclean.clean(df.limit(0), "id", "text").count() == 0


def test_reports(spark):
    df = spark.createDataFrame([(1, "a\u00a0b\u200bc" + "\u200b" * 12), (2, "plain"), (3, "x\U000e0041")], "id long, text string")
    kinds = {(r.id, r.kind): r["count"] for r in textclean.dropped_by_kind(df, "id", "text").collect()}
    assert kinds == {(1, "space"): 1, (1, "zwj_family"): 13, (3, "tag_chars"): 1}
    hits = {(r.id, r.codepoint): r for r in textclean.hits(df, "id", "text").collect()}
    assert hits[1, "U+200B"].sample_offsets == [3, *range(5, 14)] and hits[1, "U+200B"]["count"] == 13
    assert hits[1, "U+00A0"].confidence == "informational" and hits[3, "U+0041"].full_codepoint == "U+E0041"
    totals = {r.id: (r.length, r.suspicious_total) for r in textclean.totals(df, "id", "text").collect()}
    assert totals == {1: (17, 14), 2: (5, 0), 3: (2, 1)}


def test_guards(spark):
    cases = {"PNG": b"\x89PNG\r\n\x1a\njunk", "text": b"plain\ttext\n", "bad": b"\xff\xfe\x00bad", "nul": b"ab\x00", "controls": b"\x01\x02ab", "few": b"\x01abcdefgh", "empty": b""}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "name string, content binary")
    found = {r[0]: r[1] for r in df.select("name", textclean.text_error(F.col("content"))).collect()}
    assert found == {"PNG": "not valid UTF-8 text", "text": None, "bad": "not valid UTF-8 text", "nul": "looks like a binary container", "controls": "looks like a binary container", "few": None, "empty": None}
    assert df.filter(textclean.looks_binary(F.col("content"))).count() == 4


def test_plain_characters_are_never_touched():
    every = TextOptions(aggressive_homoglyphs=True)
    parts = cps.STRIPPED + cps.FORMAT + cps.EXOTIC_SPACE + cps.CONFUSABLE
    assert not [c for lo, hi in parts for c in range(lo, min(hi, 0xFF) + 1) if c <= 0x7F or c >= 0xC0]
    assert textclean.touch_class(every)


def test_rows_with_repeated_and_null_keys_stay_apart(spark):
    rows = [(1, "ab\u200bc"), (1, "xy\u200b\u200bz"), (1, "plain"), (None, "n\u200b1"), (None, "n\u00a02"), (None, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    got = sorted((r.id or 0, r.clean or "", r.n_dropped) for r in textclean.clean(df, "id", "text").collect())
    assert got == [(0, "", 0), (0, "n 2", 1), (0, "n1", 1), (1, "abc", 1), (1, "plain", 0), (1, "xyz", 2)]
    totals = sorted((r.id or 0, r.length, r.suspicious_total) for r in textclean.totals(df, "id", "text").collect())
    assert totals == [(0, 0, 0), (0, 3, 1), (0, 3, 1), (1, 4, 1), (1, 5, 0), (1, 5, 2)]
    assert sorted((r.id or 0, r["count"], r.sample_offsets) for r in textclean.hits(df, "id", "text").collect()) == [(0, 1, [1]), (0, 1, [1]), (1, 1, [2]), (1, 2, [2, 3])]
    assert sorted(r.text or "" for r in textclean.clean_column(df, "text").collect()) == ["", "abc", "n 2", "n1", "plain", "xyz"]
