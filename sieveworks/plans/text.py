"""Registered queries of text cleaning: whole tables, with code points planted in every text, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import textclean
from sieveworks.operators.textclean import TextOptions

Query = Callable[[SparkSession, str], DataFrame]
#: What is planted, what cleaning leaves of it, and kinds of the code points that it changes.
Case = tuple[str, str, tuple[str, ...]]

GLUE, BIDI, AGGRESSIVE, AS_IS = TextOptions(strip_emoji_glue=True), TextOptions(strip_bidi=True), TextOptions(aggressive_homoglyphs=True), TextOptions(normalize_spaces=False)
_FLAG = "\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f"
_FAMILY = "\U0001f468\u200d\U0001f469\u200d\U0001f467"

#: Each planted string stands between x and y, so that its neighbours are known.
PLANTED: dict[str, tuple[TextOptions, tuple[Case, ...]]] = {
    "text_clean": (textclean.DEFAULT, (("\u200b", "", ("zwj_family",)), ("\u00a0", " ", ("space",)), ("\u200e", "\u200e", ()), ("", "", ()), ("\u202e", "", ("bidi",)), (_FAMILY, _FAMILY, ()), ("\ue000", "", ("private_use",)))),
    "text_clean_zero_width": (textclean.DEFAULT, (("\u200b", "", ("zwj_family",)), ("\u200c\u200d", "", ("zwj_family",) * 2), ("\ufeff", "", ("zwj_family",)), ("\u00ad", "", ("strip",)), ("\u2062", "", ("strip",)))),
    "text_clean_spaces": (textclean.DEFAULT, (("\u00a0", " ", ("space",)), ("\u2009", " ", ("space",)), ("\u3000\u1680", "  ", ("space",) * 2), ("\u202f", " ", ("space",)))),
    "text_clean_keep_spaces": (AS_IS, (("\u00a0", "\u00a0", ()), ("\u2009\u200b", "\u2009", ("zwj_family",)), ("\u3000", "\u3000", ()))),
    "text_bidi_default": (textclean.DEFAULT, (("\u200e", "\u200e", ()), ("\u202e", "", ("bidi",)), ("\u202a", "", ("bidi",)), ("\u202aq\u202c", "\u202aq\u202c", ()), ("\u202b\u202eq\u202c\u202c", "\u202bq\u202c", ("bidi",) * 2), ("\u202c\u2067", "\u2067", ("bidi",)))),
    "text_bidi_strip": (BIDI, (("\u200e", "", ("bidi",)), ("\u202aq\u202c", "q", ("bidi",) * 2), ("\u2067", "", ("bidi",)))),
    "text_flag_tags": (textclean.DEFAULT, ((_FLAG, _FLAG, ()), ("\U000e0041", "", ("tag_chars",)), (_FLAG[:-1], "\U0001f3f4", ("tag_chars",) * 5), ("\U000e0001", "", ("tag_chars",)))),
    "text_emoji_glue": (textclean.DEFAULT, ((_FAMILY, _FAMILY, ()), ("\u2764\ufe0f\u200d\U0001f525", "\u2764\ufe0f\u200d\U0001f525", ()), ("\u2696\ufe0f", "\u2696\ufe0f", ()), ("\ufe0f", "", ("variation_selector",)), ("1\ufe0f", "1\ufe0f", ()))),
    "text_emoji_glue_paranoid": (GLUE, ((_FAMILY, "\U0001f468\U0001f469\U0001f467", ("zwj_family",) * 2), ("\u2696\ufe0f", "\u2696", ("variation_selector",)), (_FLAG, "\U0001f3f4", ("tag_chars",) * 6))),
    "text_cjk_vs": (textclean.DEFAULT, (("\u4e2d\U000e0100", "\u4e2d\U000e0100", ()), ("\u4e2d\ufe00", "\u4e2d\ufe00", ()), ("q\U000e0100", "q", ("variation_selector",)), ("q\ufe00", "q", ("variation_selector",)))),
    "text_mongolian_fvs": (textclean.DEFAULT, (("\u1820\u180b", "\u1820\u180b", ()), ("\u180b", "", ("variation_selector",)), ("\u1820\u200b\u180c", "\u1820\u180c", ("zwj_family",)), ("\u180e", "", ("zwj_family",)))),
    "text_script_joiners": (textclean.DEFAULT, (("\u06cc\u200c\u0631", "\u06cc\u200c\u0631", ()), ("\u0915\u200d\u0937", "\u0915\u200d\u0937", ()), ("\u06cc\u200c\u0937", "\u06cc\u0937", ("zwj_family",)), ("q\u200cq", "qq", ("zwj_family",)))),
    "text_khmer_hangul": (textclean.DEFAULT, (("\u1780\u17b4", "\u1780\u17b4", ()), ("\u17b5", "", ("strip",)), ("\u1100\u1160", "\u1100\u1160", ()), ("\u3164", "", ("strip",)))),
    "text_layout_cf": (textclean.DEFAULT, (("\U00013000\U00013430", "\U00013000\U00013430", ()), ("\U00013430", "", ("other_cf",)), ("\U0001bca0\U0001bc00", "\U0001bca0\U0001bc00", ()), ("\U0001d173", "", ("other_cf",)), ("\U0001343f", "\U0001343f", ()))),
    "text_orthographic_cf": (textclean.DEFAULT, (("\u0600", "\u0600", ()), ("\u06dd", "\u06dd", ()), ("\u0890", "", ("other_cf",)), ("\U000110bd", "\U000110bd", ()))),
    "text_private_use_nonchar": (textclean.DEFAULT, (("\ue000", "", ("private_use",)), ("\ufdd0", "", ("noncharacter",)), ("\u2065", "", ("reserved_ignorable",)), ("\U000f0000", "", ("private_use",)), ("\U0001ffff", "", ("noncharacter",)))),
    "text_confusables": (AGGRESSIVE, (("\u0410BC", "ABC", ("confusable",)), ("\uff21\uff5a", "Az", ("confusable",) * 2), ("\u0456", "i", ("confusable",)), ("\u0416", "\u0416", ()))),
}


def _pick(values: list[str | None], by: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(by) % len(values) + 1).cast("int"))


def planted(df: DataFrame, by: str, text: str, cases: tuple[Case, ...]) -> DataFrame:
    """df with one of the cases, by the column by, put into every text after its first by % 40 + 1 code points."""
    p, whole = (F.col(by) % 40 + 1).cast("int"), F.col(text)
    return df.withColumn(text, F.concat(F.substr(whole, F.lit(1), p), F.lit("x"), _pick([c[0] for c in cases], by), F.lit("y"), F.substr(whole, p + 1)))


def _string(text: str) -> str:
    """A DuckDB expression for a string with any code points."""
    return " || ".join(f"chr({ord(c)})" for c in text) or "''"


def _case_sql(values: list[str], by: str) -> str:
    return "CASE " + " ".join(f"WHEN {by} % {len(values)} = {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _planted_sql(by: str, text: str, strings: list[str]) -> str:
    chosen = _case_sql([_string(s) for s in strings], by)
    return f"substr({text}, 1, ({by} % 40 + 1)::int) || 'x' || ({chosen}) || 'y' || substr({text}, ({by} % 40 + 2)::int)"


def _cleaning(name: str) -> tuple[Query, str]:
    options, cases = PLANTED[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text", cases)
        out = textclean.clean(docs, "doc_id", "text", options)
        return out.select("doc_id", F.md5("clean").alias("clean_md5"), "bytes_in", "bytes_out", "n_dropped")

    dropped = _case_sql([str(len(c[2])) for c in cases], "doc_id")
    before, after = (_planted_sql("doc_id", "text", [c[k] for c in cases]) for k in (0, 1))
    sql = f"""SELECT doc_id, md5({after}) AS clean_md5, strlen({before})::bigint AS bytes_in, strlen({after})::bigint AS bytes_out,
        CASE WHEN text IS NULL THEN 0 ELSE {dropped} END::bigint AS n_dropped FROM documents"""
    return query, sql


MIXED = tuple(c for name in ("text_clean", "text_flag_tags", "text_bidi_default", "text_layout_cf") for c in PLANTED[name][1])


def dropped_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text", MIXED)
    kinds = textclean.dropped_by_kind(docs, "doc_id", "text")
    return kinds.groupBy("kind").agg(F.count("*").alias("documents"), F.sum("count").alias("code_points"))


def _kinds_sql() -> str:
    rows = ", ".join(f"({k}, '{kind}', {c[2].count(kind)})" for k, c in enumerate(MIXED) for kind in sorted(set(c[2])))
    return f"""SELECT kind, count(*) AS documents, sum(n)::bigint AS code_points FROM documents
        JOIN (VALUES {rows}) AS v(k, kind, n) ON doc_id % {len(MIXED)} = v.k WHERE text IS NOT NULL GROUP BY kind"""


HITS = (("\u200b\u200bq\u200b", "q", ("zwj_family",) * 3), ("\u00a0", " ", ("space",)), ("\U000e0041", "", ("tag_chars",)), ("\u200b" * 12, "", ("zwj_family",) * 12), ("", "", ()))


def text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text", HITS)
    out = textclean.hits(docs, "doc_id", "text")
    return out.select("doc_id", "codepoint", "full_codepoint", "kind", "confidence", "count", F.array_join(F.transform("sample_offsets", lambda x: x.cast("string")), ",").alias("offsets"))


def _hits_sql() -> str:
    spots = ([0, 1, 3], [0], [0], list(range(10)))
    what = (("U+200B", "U+200B", "zwj_family"), ("U+00A0", "U+00A0", "space"), ("U+0041", "U+E0041", "tag_chars"), ("U+200B", "U+200B", "zwj_family"))
    rows = ", ".join(f"({k}, '{a}', '{b}', '{kind}', {len(HITS[k][2])}, {s})" for k, (s, (a, b, kind)) in enumerate(zip(spots, what, strict=True)))
    return f"""SELECT doc_id, codepoint, full_codepoint, kind, CASE WHEN kind = 'space' THEN 'informational' ELSE 'probable' END AS confidence, n::bigint AS "count",
        array_to_string(list_transform(spots, lambda s: (s + 1 + least(doc_id % 40 + 1, length(text)))::varchar), ',') AS offsets
        FROM documents JOIN (VALUES {rows}) AS v(k, codepoint, full_codepoint, kind, n, spots) ON doc_id % {len(HITS)} = v.k WHERE text IS NOT NULL"""


def inspect_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text", HITS)
    return textclean.totals(docs, "doc_id", "text")


def _totals_sql() -> str:
    before = _planted_sql("doc_id", "text", [c[0] for c in HITS])
    n = _case_sql([str(len(c[2])) for c in HITS], "doc_id")
    return f"SELECT doc_id, coalesce(length({before}), 0)::bigint AS length, CASE WHEN text IS NULL THEN 0 ELSE {n} END::bigint AS suspicious_total FROM documents"


#: Bytes put before a text, and what the guard says of the whole.
GUARDED = ((b"", None), (b"\x89PNG\r\n\x1a\n", "not valid UTF-8 text"), (b"\xff\xfe", "not valid UTF-8 text"), (b"GIF89a", "looks like a binary container"), (b"RIFF", "looks like a binary container"), (b"PK\3\4", "looks like a binary container"), (b"a\0", "looks like a binary container"), (b"\1", None))


def binary_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prefix = F.element_at(F.array(*(F.lit(bytearray(p)) for p, _ in GUARDED)), (F.col("doc_id") % len(GUARDED) + 1).cast("int"))
    return docs.select("doc_id", textclean.text_error(F.concat(prefix, F.coalesce("text", F.lit("")).cast("binary"))).alias("error"))


def _guard_sql() -> str:
    # a text of up to two bytes after one control byte is over 30 % controls
    last = "CASE WHEN strlen(coalesce(text, '')) <= 2 THEN 'looks like a binary container' END"
    answers = [last if p == b"\1" else "NULL" if e is None else f"'{e}'" for p, e in GUARDED]
    return f"SELECT doc_id, {_case_sql(answers, 'doc_id')} AS error FROM documents"


def _table(table: str, text: str, keys: list[str]) -> tuple[Query, str]:
    """Cleaning of another table's texts, with a zero-width space put after the first code point of each."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.struct(*keys).alias("key"), F.concat(F.substr(text, F.lit(1), F.lit(1)), F.lit("\u200bq\u00a0"), F.substr(F.col(text), F.lit(2))).alias("text"))
        out = textclean.clean(rows, "key", "text")
        return out.select("key.*", F.md5("clean").alias("clean_md5"), "bytes_out", "n_dropped")

    after = f"substr({text}, 1, 1) || 'q ' || substr({text}, 2)"
    return query, f"SELECT {', '.join(keys)}, md5({after}) AS clean_md5, strlen({after})::bigint AS bytes_out, CASE WHEN {text} IS NULL THEN 0 ELSE 2 END::bigint AS n_dropped FROM {table}"


def media_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = (("\U000e0001\u00a0", "\u00a0", ("tag_chars",)), ("\u200b", "", ("zwj_family",)), ("", "", ()))
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text", cases)
    return textclean.clean_column(docs, "text", textclean.SCRUB).select("doc_id", F.md5("text").alias("clean_md5"))


_SCRUB_SQL = f"SELECT doc_id, md5({_planted_sql('doc_id', 'text', [chr(0xA0), '', ''])}) AS clean_md5 FROM documents"

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _name, (_query, _sql) in (
    *((n, _cleaning(n)) for n in PLANTED),
    ("text_dropped_by_kind", (dropped_by_kind, _kinds_sql())),
    ("text_hits", (text_hits, _hits_sql())),
    ("text_inspect_totals", (inspect_totals, _totals_sql())),
    ("text_binary_guard", (binary_guard, _guard_sql())),
    ("page_html_clean", _table("pages", "html", ["page_id"])),
    ("conversation_clean", _table("conversations", "text", ["conv_id", "turn"])),
    ("event_props_clean", _table("events", "props", ["event_id"])),
    ("media_string_scrub", (media_scrub, _SCRUB_SQL)),
):
    QUERIES[_name], ORACLE_SQL[_name] = _query, _sql
