"""Line deduplication: lines that many documents hold go from all but one, by DataFrame functions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import saved

#: White space that is stripped at the ends of a line: ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
#: Code points of the shortest key that counts, and documents from which on its lines are dropped.
LEAST_LENGTH, LEAST_DOCS = 20, 3
OWN = ("n_lines", "n_dropped", "kept")


def line_key(line: Column) -> Column:
    """What makes two lines equal: no white space at the ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(text: Column) -> Column:
    """Tells the rows of one doc_id apart: 32 bits of the text's hash, in the upper half of a long."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)), 32)


def line_table(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(h1, h2, doc_id, place) of every line whose key has enough code points.

    A key is told by two 64-bit hashes, as one would meet others among 10^11 lines. place is the row's tag and, in its
    lower half, the line's position in the text.
    """
    cut = docs.select("doc_id", _row(F.col("text")).alias("row"), _lines(F.col("text")).alias("lines"))  # once a text, not a line
    lines = cut.select("doc_id", "row", F.posexplode("lines").alias("at", "line"))
    keyed = lines.select("doc_id", "row", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least_length)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", F.col("row").bitwiseOR(F.col("at").cast("long")).alias("place"))


def frequent_keys(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2, keeper) of the keys found in enough documents; keeper is the largest doc_id that holds one.

    Counting distinct documents takes two steps, (key, document) and then key, each aggregated before its shuffle: a
    line that a third of all documents hold reaches its task as one row for each task before it.
    """
    once = lines.select("h1", "h2", "doc_id").distinct()
    counted = once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("n_docs") >= least_docs).select("h1", "h2", "keeper")


def dedup(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with ``n_lines``, ``n_dropped`` and ``kept``: the text without the lines that many documents hold.

    Texts are split at ``\\n``. A line's key is line_key() of it; keys of least_length code points or more that
    least_docs documents or more hold lose all their lines, repeats included, but those of the largest doc_id among
    them. Shorter and rarer lines stay as they are, in order, joined by ``\\n``.

    Lines are exploded and hashed in one pass; keys are counted with partial aggregates and the frequent ones saved
    (a lost executor costs no second count); a second pass joins them to the lines (a hot key's lines are split over
    tasks by the adaptive skew join, or the keys are broadcast where Spark knows their size); positions to drop are
    gathered for each row, at most its number of lines, and met with the row once more. Positions are removed by a
    hashed set difference, so that very long texts take time in proportion to their lines.

    Null or empty text: one empty line, kept as "". Rows of one doc_id are one document when counted and for keepers;
    each row loses its own lines. Null doc_id: all such rows are one document, smaller than any other. Repeated rows:
    the same result each. Empty table: no rows. Other columns stay, whatever their names; n_lines, n_dropped and kept
    replace columns of those names.
    """
    lines = line_table(docs, least_length)
    frequent = saved(frequent_keys(lines, least_docs), "line-keys")
    hit = lines.alias("l").join(frequent.alias("f"), ["h1", "h2"]).filter(~F.col("l.doc_id").eqNullSafe(F.col("f.keeper")))
    at = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    row = F.shiftleft(F.shiftright(F.col("place"), 32), 32)
    dropped = hit.groupBy("doc_id", row.alias("row")).agg(F.collect_set(at).alias("dropped"))
    keep = [c for c in docs.columns if c not in OWN]
    cut = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep if c != "text")).alias("rest"), F.col("doc_id"), F.col("text").isNull().alias("no_text"), _row(F.col("text")).alias("row"), _lines(F.col("text")).alias("lines"))
    both = cut.alias("c").join(dropped.alias("d"), F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("c.row") == F.col("d.row")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    lines_kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("lines"), i)))
    text = F.when(~F.col("no_text"), F.array_join("lines", "\n"))
    columns = [text.alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in keep]
    return both.select(*columns, F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(lines_kept, "\n").alias("kept"))
