"""Classes of Unicode code points: range tables, and the column predicates and regex classes made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Ranges = tuple[tuple[int, int], ...]


def ranges(text: str) -> Ranges:
    """``"00AD 200B-200F"`` as ((0xAD, 0xAD), (0x200B, 0x200F))."""
    pairs = (part.partition("-") for part in text.split())
    return tuple((int(lo, 16), int(hi or lo, 16)) for lo, _, hi in pairs)


# The classes that cleaning distinguishes.
INVISIBLE = ranges("00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-2064 2066-206F 3164 FE00-FE0F FEFF FFA0 FFF9-FFFB")
VS_SUPPLEMENT = ranges("E0100-E01EF")
TAG_CHARS = ranges("E0001-E007F")
TAG_RANGE = ranges("E0020-E007F")
RESERVED = ranges("2065 FFF0-FFF8 E0000 E0080-E00FF E01F0-E0FFF")
PRIVATE_USE = ranges("E000-F8FF F0000-FFFFD 100000-10FFFD")
NONCHARACTER = ranges("FDD0-FDEF") + tuple((plane << 16 | 0xFFFE, plane << 16 | 0xFFFF) for plane in range(17))
EXOTIC_SPACE = ranges("00A0 1680 2000-200A 202F 205F 3000")
BIDI = ranges("061C 200E-200F 202A-202E 2066-2069")
BIDI_KEPT = ranges("061C 200E-200F 2066-2069")
BIDI_EMBED = ranges("202A-202B")
BIDI_OPEN = ranges("202A-202B 202D-202E")
BIDI_POP = 0x202C
ZERO_WIDTH = ranges("180E 200B-200D 2060 FEFF")
EMOJI_SELECTOR = ranges("FE0E-FE0F")
TEXT_SELECTOR = ranges("FE00-FE0D")
VS_BASIC = ranges("FE00-FE0F")
MONGOLIAN_FVS = ranges("180B-180D 180F")
JOINER = ranges("200C-200D")
KHMER_VOWEL = ranges("17B4-17B5")
HANGUL_FILLER = ranges("115F-1160 3164 FFA0")
ORTHOGRAPHIC = ranges("0600-0605 06DD 070F 08E2 110BD 110CD")
FORMAT_ONLY = ranges("0890-0891")
LAYOUT_FORMAT = ranges("13430-13438 1BCA0-1BCA3 1D173-1D17A")
EMOJI_BASE = ranges("0023 002A 0030-0039 00A9 00AE 203C 2049 2122 2139 2190-25FF 2600-27BF 2934-2935 2B00-2BFF 3030 303D 3297 3299 1F000-1FAFF")
CJK = ranges("3400-4DBF 4E00-9FFF F900-FAFF 20000-323AF")
MONGOLIAN_BASE = ranges("1800-18AF")
MONGOLIAN_LETTER = ranges("1820-18AA")
KHMER_LETTER = ranges("1780-17B3")
HANGUL_JAMO = ranges("1100-11FF 3131-318E A960-A97C D7B0-D7C6 FFA1-FFDC")
#: Scripts whose letters join; one group each.
JOINING_SCRIPTS = (ranges("0600-08FF"), ranges("0900-0DFF"), ranges("0F00-109F"), ranges("1780-17FF"), ranges("1800-18AF"))
#: Layout controls, and the script beside which each is visible.
LAYOUT_NEAR = (
    (ranges("13430-1343F"), ranges("13000-143FF")),
    (ranges("1BCA0-1BCA3"), ranges("1BC00-1BCA3")),
    (ranges("1D173-1D17A"), ranges("1D100-1D1FF")),
)
WAVING_BLACK_FLAG = 0x1F3F4
#: Cyrillic letters that look like Latin ones; the full-width Latin letters follow by rule.
CYRILLIC_LATIN = (
    (0x0410, "A"), (0x0412, "B"), (0x0415, "E"), (0x041A, "K"), (0x041C, "M"), (0x041D, "H"), (0x041E, "O"),
    (0x0420, "P"), (0x0421, "C"), (0x0422, "T"), (0x0425, "X"), (0x0430, "a"), (0x0435, "e"), (0x043E, "o"),
    (0x0440, "p"), (0x0441, "c"), (0x0443, "y"), (0x0445, "x"), (0x0456, "i"),
)
FULLWIDTH_LETTERS = ranges("FF21-FF3A FF41-FF5A")

CONFUSABLE: Ranges = tuple((cp, cp) for cp, _ in CYRILLIC_LATIN) + FULLWIDTH_LETTERS
STRIPPED: Ranges = INVISIBLE + VS_SUPPLEMENT + TAG_CHARS + NONCHARACTER + RESERVED + PRIVATE_USE
FORMAT: Ranges = INVISIBLE + ORTHOGRAPHIC + FORMAT_ONLY + LAYOUT_FORMAT + TAG_CHARS
GLUE: Ranges = JOINER + VS_SUPPLEMENT + VS_BASIC + MONGOLIAN_FVS + TAG_RANGE + KHMER_VOWEL + HANGUL_FILLER


def merged(parts: Ranges) -> Ranges:
    """The same set as sorted, disjoint, non-adjacent ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(parts):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return tuple(out)


def inside(cp: Column, parts: Ranges) -> Column:
    """Is the code point in the set? False, never null, for null."""
    tests = [cp == lo if lo == hi else cp.between(lo, hi) for lo, hi in merged(parts)]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def regex_class(parts: Ranges) -> str:
    """The set as the inside of a Java regex class."""
    one = "\\x{{{:X}}}".format
    return "".join(one(lo) if lo == hi else f"{one(lo)}-{one(hi)}" for lo, hi in merged(parts))


def confusable_to_latin(cp: Column) -> Column:
    """The Latin letter that a confusable code point looks like."""
    found = F.when(cp.between(0xFF21, 0xFF5A), F.char((cp - 0xFEE0).cast("int")))
    for code, letter in CYRILLIC_LATIN:
        found = found.when(cp == code, F.lit(letter))
    return found


def short_label(cp: Column) -> Column:
    """``U+`` and the last four hex digits: supplementary code points lose their plane."""
    return F.concat(F.lit("U+"), F.right(F.lpad(F.hex(cp), 8, "0"), F.lit(4)))


def full_label(cp: Column) -> Column:
    """``U+`` and at least four hex digits."""
    digits = F.hex(cp)
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))
