"""Invisible-Unicode cleaning of text columns, as regex tokens, windows and one CASE over code points.

A text without any code point that a rule could touch is passed through by one RLIKE. The others are split into
tokens - one for each touchable code point, one for each run between them - so that a document makes rows in
proportion to its suspicious code points, not to its length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.functions import codepoints as cps
from sieveworks.functions.codepoints import inside


@dataclass(frozen=True)
class TextOptions:
    """What cleaning does. nfkc is accepted and has no effect."""

    normalize_spaces: bool = True
    aggressive_homoglyphs: bool = False
    strip_emoji_glue: bool = False
    strip_bidi: bool = False
    nfkc: bool = False


DEFAULT = TextOptions()
#: Metadata strings of media files: spaces and marks stay.
SCRUB = TextOptions(normalize_spaces=False)


def inspecting(options: TextOptions) -> TextOptions:
    """Inspection always counts exotic spaces and bidi marks."""
    return replace(options, normalize_spaces=True, strip_bidi=True)


def touch_class(options: TextOptions) -> str:
    """Regex class of the code points that some rule may change; all others are kept."""
    parts = cps.STRIPPED + cps.FORMAT
    parts += cps.EXOTIC_SPACE if options.normalize_spaces else ()
    parts += cps.CONFUSABLE if options.aggressive_homoglyphs else ()
    return cps.regex_class(parts)


#: Most characters of most texts, which no rule touches: Java tests this part of a class by table, before the ranges.
PLAIN = "\\x00-\\x7F\\xC0-\\xFF"


def touched(text: Column, options: TextOptions = DEFAULT) -> Column:
    return F.coalesce(text.rlike(f"(?=[^{PLAIN}])[{touch_class(options)}]"), F.lit(False))


def _tokens(text: Column, options: TextOptions) -> Column:
    """Array of tokens whose concatenation is the text; a complete flag sequence is one token where glue is kept."""
    touch, flag = touch_class(options), f"\\x{{{cps.WAVING_BLACK_FLAG:X}}}"
    whole = "" if options.strip_emoji_glue else f"{flag}[\\x{{E0020}}-\\x{{E007E}}]+\\x{{E007F}}|"
    return F.regexp_extract_all(text, F.lit(f"[{PLAIN}[^{touch}{flag}]]+|{whole}[{touch}]|{flag}"), F.lit(0))


def _kind(cp: Column) -> Column:
    kinds = (
        ("tag_chars", cps.TAG_CHARS),
        ("noncharacter", cps.NONCHARACTER),
        ("reserved_ignorable", cps.RESERVED),
        ("variation_selector", cps.VS_SUPPLEMENT + cps.VS_BASIC + cps.MONGOLIAN_FVS),
        ("bidi", cps.BIDI),
        ("zwj_family", cps.ZERO_WIDTH),
        ("private_use", cps.PRIVATE_USE),
    )
    out = F
    for name, parts in kinds:
        out = out.when(inside(cp, parts), F.lit(name))
    return out.otherwise(F.lit("strip"))


def _script(cp: Column) -> Column:
    out = F
    for k, parts in enumerate(cps.JOINING_SCRIPTS, 1):
        out = out.when(inside(cp, parts), F.lit(k))
    return out


def _kept_by_input(cp: Column, before: Column, after: Column, paired: Column, options: TextOptions) -> Column:
    """Rules for keeping that depend on the input's neighbours alone."""
    keep = F.lit(False)
    if not options.strip_bidi:
        keep = keep | paired | inside(cp, cps.BIDI_KEPT)
    if not options.strip_emoji_glue:
        beside = F.lit(False)
        for controls, script in cps.LAYOUT_NEAR:
            beside = beside | (inside(cp, controls) & (inside(before, script) | inside(after, script)))
        keep = (
            keep
            | (inside(cp, cps.VS_SUPPLEMENT + cps.TEXT_SELECTOR) & inside(before, cps.CJK))
            | (inside(cp, cps.MONGOLIAN_FVS) & inside(before, cps.MONGOLIAN_BASE))
            | (inside(cp, cps.EMOJI_SELECTOR) & inside(before, cps.EMOJI_BASE))
            | (inside(cp, cps.JOINER) & F.coalesce(_script(before) == _script(after), F.lit(False)))
            | inside(cp, cps.ORTHOGRAPHIC)
            | beside
        )
    return keep


def _kept_by_base(cp: Column, base: Column, after: Column, options: TextOptions) -> Column:
    """Rules for keeping glue, by the last kept code point that isn't glue."""
    if options.strip_emoji_glue:
        return F.lit(False)
    return (
        ((cp == 0x200D) & inside(base, cps.EMOJI_BASE) & inside(after, cps.EMOJI_BASE))
        | (inside(cp, cps.MONGOLIAN_FVS) & inside(base, cps.MONGOLIAN_LETTER))
        | (inside(cp, cps.KHMER_VOWEL) & inside(base, cps.KHMER_LETTER))
        | (inside(cp, cps.HANGUL_FILLER) & inside(base, cps.HANGUL_JAMO))
    )


def _changed(cp: Column, options: TextOptions) -> Column:
    """What becomes of a code point that no rule keeps, as struct<out, kind>; null kind: kept after all."""
    out = F.when(inside(cp, cps.STRIPPED), F.struct(F.lit("").alias("out"), _kind(cp).alias("kind")))
    if options.normalize_spaces:
        out = out.when(inside(cp, cps.EXOTIC_SPACE), F.struct(F.lit(" ").alias("out"), F.lit("space").alias("kind")))
    if options.aggressive_homoglyphs:
        out = out.when(inside(cp, cps.CONFUSABLE), F.struct(cps.confusable_to_latin(cp).alias("out"), F.lit("confusable").alias("kind")))
    return out.when(inside(cp, cps.FORMAT), F.struct(F.lit("").alias("out"), F.lit("other_cf").alias("kind")))


def _with_pairs(tokens: DataFrame, options: TextOptions, by: Sequence[str]) -> DataFrame:
    """Adds paired: is the token an embedding opener, or the pop that closes one?

    The stack is closed-form: its depth is the running sum of openers less pops, reflected at zero, and openers and
    their pops alternate within (text, level).
    """
    if options.strip_bidi:
        return tokens.withColumn("paired", F.lit(False))
    cp, row = F.col("cp"), Window.partitionBy(*by).orderBy("pos")
    step = F.when(inside(cp, cps.BIDI_OPEN), 1).when(cp == cps.BIDI_POP, -1).otherwise(0)
    running = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = tokens.withColumn("step", step).withColumn("sum", F.sum("step").over(running))
    out = out.withColumn("low", F.least(F.lit(0), F.min("sum").over(running)))
    out = out.withColumn("low_before", F.coalesce(F.lag("low").over(row), F.lit(0)))
    level = F.when(F.col("step") == 1, F.col("sum") - F.col("low")).when((F.col("step") == -1) & (F.col("low") == F.col("low_before")), F.col("sum") - F.col("low") + 1)
    out = out.withColumn("level", F.coalesce(level, F.lit(0)))
    at = Window.partitionBy(*by, "level").orderBy("pos")
    opens = inside(cp, cps.BIDI_EMBED) & (F.lead("cp").over(at) == cps.BIDI_POP)
    closes = (cp == cps.BIDI_POP) & inside(F.lag("cp").over(at), cps.BIDI_EMBED)
    paired = F.coalesce((F.col("level") > 0) & (opens | closes), F.lit(False))
    return out.withColumn("paired", paired).drop("step", "sum", "low", "low_before", "level")


def decisions(df: DataFrame, key: str, text: str, options: TextOptions = DEFAULT) -> DataFrame:
    """The tokens of every touched text, each with its fate: (id, key, pos, offset, token, cp, out, kind).

    id tells rows apart, so that key may be null or repeat. offset counts code points from 0; cp is null for runs that
    nothing touches; kind is null for what is kept. Texts that nothing touches (null and empty ones included) give no
    row.
    """
    found = df.filter(touched(F.col(text), options)).select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), _tokens(F.col(text), options).alias("tokens"))
    return _decided(found.select("id", "key", F.posexplode("tokens").alias("pos", "token")), options, "key")


def _decided(tokens: DataFrame, options: TextOptions, *carried: str, by: Sequence[str] = ("id",)) -> DataFrame:
    """The fate of each token; by tells the texts apart that the tokens are of, and is carried along."""
    one = F.col("token").rlike(f"^[{touch_class(options)}]$")
    row = Window.partitionBy(*by).orderBy("pos")
    tokens = tokens.withColumns(
        {
            "cp": F.when(one, F.ascii("token")),
            "before": F.ascii(F.right(F.lag("token").over(row), F.lit(1))),
            "after": F.ascii(F.left(F.lead("token").over(row), F.lit(1))),
            "offset": F.coalesce(F.sum(F.length("token").cast("long")).over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "last": F.when(F.ascii("token") == cps.WAVING_BLACK_FLAG, F.ascii("token")).otherwise(F.ascii(F.right("token", F.lit(1)))),
        }
    )
    tokens = _with_pairs(tokens, options, by)
    cp, glue = F.col("cp"), inside(F.col("cp"), cps.GLUE)
    kept = cp.isNull() | _kept_by_input(cp, F.col("before"), F.col("after"), F.col("paired"), options)
    tokens = tokens.withColumn("kept", kept).withColumn("change", F.when(~F.col("kept"), _changed(cp, options)))
    left = F.when(~glue, F.when(F.col("change.kind").isNull(), F.col("last")).when(F.col("change.out") != "", F.ascii("change.out")))
    tokens = tokens.withColumn("left", left)
    tokens = tokens.withColumn("base", F.last("left", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, -1)))
    change = F.when(~_kept_by_base(cp, F.col("base"), F.col("after"), options), F.col("change"))
    tokens = tokens.withColumn("change", change)
    return tokens.select(*by, *carried, "pos", "offset", "token", "cp", F.coalesce("change.out", "token").alias("out"), F.col("change.kind").alias("kind"))


def clean(df: DataFrame, key: str, text: str, options: TextOptions = DEFAULT) -> DataFrame:
    """(key, clean, bytes_in, bytes_out, n_dropped, dropped) for every row of df; null text: null clean and bytes.

    dropped lists (kind, count) by kind. Only touched texts are shuffled, once, by a row number: key may be null or
    repeat, and each row is cleaned by itself.
    """
    whole = F.col(text)
    none = F.array().cast("array<struct<id:string,size:bigint>>")
    same = df.filter(~touched(whole, options)).select(F.col(key), whole.alias("clean"), F.octet_length(whole).cast("long").alias("bytes_in"), F.lit(0).cast("long").alias("n_dropped"), none.alias("dropped"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "out", "token", "kind")))
    kinds = F.array_compact("parts.kind")
    counts = F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("id"), F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias("size")))
    changed = (
        decisions(df, key, text, options)
        .groupBy("id")
        .agg(F.first("key").alias("key"), parts.alias("parts"), F.count("kind").alias("n_dropped"))
        .select(
            F.col("key").alias(key),
            F.array_join(F.col("parts.out"), "").alias("clean"),
            F.octet_length(F.array_join(F.col("parts.token"), "")).cast("long").alias("bytes_in"),
            "n_dropped",
            counts.alias("dropped"),
        )
    )
    out = same.unionByName(changed)
    return out.select(key, "clean", "bytes_in", F.octet_length("clean").cast("long").alias("bytes_out"), "n_dropped", "dropped")


def clean_strings(df: DataFrame, key: Sequence[str], strings: str, options: TextOptions = DEFAULT) -> DataFrame:
    """df with each string of its array column ``strings`` cleaned by itself, read once; null ones stay null.

    For small rows that cost much to make, as values parsed out of files: every row is shuffled once, by its key, and
    none is made twice. Beside it go the tokens of its touched strings alone. key must tell rows apart and be the same
    in every run of a task, so that a task that runs again sends each row where its first run did.
    """
    split = F.transform(strings, lambda x, i: F.struct(i.alias("slot"), F.when(touched(x, options), _tokens(x, options)).alias("tokens")))
    flat = lambda s: F.transform(s["tokens"], lambda x, i: F.struct(s["slot"].alias("slot"), i.alias("pos"), x.alias("token")))
    tokens = F.flatten(F.transform(F.filter(split, lambda s: s["tokens"].isNotNull()), flat))
    itself = F.array(F.struct(F.lit(-1).alias("slot"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("token")))
    rest = [c for c in df.columns if c not in (*key, strings)]
    rows = df.select(F.struct(*key).alias("id"), F.struct(F.lit(0).alias("none"), *rest, strings).alias("row"), F.explode(F.concat(itself, F.coalesce(tokens, F.array()))).alias("t"))
    each = rows.select("id", F.when(F.col("t.slot") < 0, F.col("row")).alias("row"), "t.*").repartition("id")
    parts = F.array_sort(F.collect_list(F.when(F.col("slot") >= 0, F.struct("slot", "pos", "out"))))
    whole = _decided(each, options, "row", by=("id", "slot")).groupBy("id").agg(F.first("row", ignorenulls=True).alias("row"), parts.alias("parts"))
    own = lambda i: F.filter("parts", lambda p: p["slot"] == i)
    joined = F.transform(F.col("row")[strings], lambda x, i: F.when(F.exists("parts", lambda p: p["slot"] == i), F.array_join(F.transform(own(i), lambda p: p["out"]), "")).otherwise(x))
    runs = F.when(F.size("parts") == 0, F.col("row")[strings]).otherwise(joined)
    return whole.select(*(runs.alias(c) if c == strings else (F.col("id")[c] if c in key else F.col("row")[c]).alias(c) for c in df.columns))


def clean_column(df: DataFrame, text: str, options: TextOptions = DEFAULT) -> DataFrame:
    """df with its column text cleaned, read once.

    For small rows that cost much to make, as values parsed out of files: every row is shuffled, none is made twice.
    """
    whole = F.col(text)
    tokens = F.when(touched(whole, options), _tokens(whole, options)).otherwise(F.array(whole))
    rows = df.select(F.monotonically_increasing_id().alias("id"), F.struct(*df.columns).alias("row"), tokens.alias("tokens"))
    exploded = rows.select("id", "row", F.posexplode("tokens").alias("pos", "token")).withColumn("row", F.when(F.col("pos") == 0, F.col("row")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "out")))
    whole_rows = _decided(exploded, options, "row").groupBy("id").agg(F.first("row", ignorenulls=True).alias("row"), parts.alias("parts"))
    cleaned = F.when(F.col(f"row.{text}").isNotNull(), F.array_join(F.col("parts.out"), ""))
    return whole_rows.select(*(cleaned.alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in df.columns))


def dropped_by_kind(df: DataFrame, key: str, text: str, options: TextOptions = DEFAULT) -> DataFrame:
    """(key, kind, count): how many code points each kind of rule removed or replaced, for each key."""
    found = decisions(df, key, text, options).filter("kind is not null")
    return found.groupBy(F.col("key").alias(key), "kind").agg(F.count("*").alias("count"))


#: Offsets that a hit shows.
SAMPLES = 10


def hits(df: DataFrame, key: str, text: str, options: TextOptions = DEFAULT) -> DataFrame:
    """Suspicious code points of each row: (key, cp, codepoint, full_codepoint, kind, confidence, count, sample_offsets).

    sample_offsets holds the first SAMPLES offsets of each, counted in code points.
    """
    found = decisions(df, key, text, inspecting(options)).filter("kind is not null")
    rank = F.row_number().over(Window.partitionBy("id", "cp", "kind").orderBy("offset"))
    some = F.collect_list(F.when(F.col("rank") <= SAMPLES, F.col("offset")))
    out = found.withColumn("rank", rank).groupBy("id", "cp", "kind").agg(F.first("key").alias("key"), F.count("*").alias("count"), F.array_sort(some).alias("sample_offsets"))
    confidence = F.when(F.col("kind") == "space", "informational").otherwise("probable")
    return out.select(F.col("key").alias(key), "cp", cps.short_label(F.col("cp")).alias("codepoint"), cps.full_label(F.col("cp")).alias("full_codepoint"), "kind", confidence.alias("confidence"), "count", "sample_offsets")


def totals(df: DataFrame, key: str, text: str, options: TextOptions = DEFAULT) -> DataFrame:
    """(key, length, suspicious_total) for every row; length counts code points."""
    same = df.filter(~touched(F.col(text), inspecting(options))).select(F.col(key), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("length"), F.lit(0).cast("long").alias("suspicious_total"))
    found = decisions(df, key, text, inspecting(options)).groupBy("id").agg(F.first("key").alias("key"), F.sum(F.length("token").cast("long")).alias("length"), F.count("kind").alias("suspicious_total"))
    return same.unionByName(found.select(F.col("key").alias(key), "length", "suspicious_total"))


# What an inspection says of its limits, and, last, of a text without a hit.
NOTES = (
    "Layer A only: invisible/format Unicode and space homoglyphs (edit-based carriers).",
    "Statistical (token-sampling) watermarks are not detectable here.",
    "Inspect kinds: strip, bidi, tag_chars, variation_selector, zwj_family, private_use, space, confusable, other_cf.",
    "Load-bearing invisibles are preserved by default during cleaning: emoji glue, CJK/Mongolian variation selectors, script joiners, complete flag tag sequences, same-script fillers/selectors, RTL directional marks/paired embeddings, orthographic Cf, visible-layout controls next to their own script. Use explicit strip flags only after review.",
)
NO_HITS = "No deterministic Layer A (invisible Unicode/format) carriers detected."


def report(df: DataFrame, key: str, text: str, options: TextOptions = DEFAULT) -> DataFrame:
    """totals() with notes, an array of sentences."""
    notes = F.array(*map(F.lit, NOTES))
    return totals(df, key, text, options).withColumn("notes", F.when(F.col("suspicious_total") == 0, F.array_append(notes, F.lit(NO_HITS))).otherwise(notes))


#: Bytes that the guard against binary content looks at.
SNIFFED = 4096


def looks_binary(content: Column) -> Column:
    """Does a BINARY start like a known container, hold a NUL near its start, or consist of controls there by over 30%?"""
    head = F.hex(F.substring(content, 1, SNIFFED))
    # Signatures of PNG, JPEG, GIF87a, GIF89a, RIFF and ZIP.
    known = [head.startswith(x) for x in ("89504E470D0A1A0A", "FFD8", "474946383761", "474946383961", "52494646", "504B0304")]
    bytes_ = F.regexp_replace(head, "(..)", "$1 ")
    nul = bytes_.rlike("(?:^| )00 ")
    others = F.regexp_replace(bytes_, "(?:0[1-8BCEF]|1[0-9A-F]|7F) ", "")
    controls = (F.length(bytes_) - F.length(others)) / 3
    much = controls * 100 > F.length(bytes_) / 3 * 30
    start = known[0]
    for k in known[1:]:
        start = start | k
    return F.coalesce(start | nul | much, F.lit(False))


def text_error(content: Column, force_text: bool = False) -> Column:
    """Why a BINARY isn't taken as text; null: it is."""
    if force_text:
        return F.lit(None).cast("string")
    bad = F.when(~F.is_valid_utf8(content.cast("string")), F.lit("not valid UTF-8 text"))
    return bad.when(looks_binary(content), F.lit("looks like a binary container"))
