"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.llm.common import n_words, saved

#: Weights that the sources take in turn, sorted by code point, null last.
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2.0
#: The order inside one (source, size) group is cut into ranges of about so many rows of the table, LEAST_RANGES at least.
RANGE_ROWS, LEAST_RANGES = 200_000, 64
#: Place of a row in the order of its size, below so much.
PLACES = 1 << 60


def place(*parts: Column | str) -> Column:
    """A number below PLACES from the MD5 of the parts that aren't null."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row a source.

    Each source gets its weight's part of total_share times all sizes; a target above most times its source's size
    stops there and the excess is shared again by weight. The final level is found in closed form: sources sorted by
    cap/weight are capped in that order, so with prefix sums the cut is the first source whose cap is not exceeded.
    The rows are one a source; they are sorted in one window (a catalogue of sources, not of documents).
    """
    n = len(weights)
    nth = F.row_number().over(W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % n + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = W.partitionBy()
    before = W.orderBy("ratio", F.col("source").isNull(), F.encode("source", "utf-8")).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("all_size", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    s = s.withColumn("left_size", total_share * F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left_size") / F.col("left_weight"))
    # levels only fall after the first source that stays under its cap, so the largest such level is that source's
    s = s.withColumn("final", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("final"), F.col("cap")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """Every document with its size, its source's size and target, and how many copies the mix takes of it.

    Systematic sampling: a document's expected copies are target / source_size (at most ``most``); they are
    prefix-summed within the source, one offset drawn from the seed is added, and a copy is emitted at each integer
    boundary crossed. Documents come in the order of size, so that the taken words stay within about one largest
    document of the target whatever the sizes are. Ties: by a hash of seed, id and text.

    The prefix sum is two-level, and a source with any part of all rows is spread over tasks: sizes are cut to
    (source, size, range of the hash) cells by a partially aggregated count, cells are summed in order, and ranks are
    taken inside one cell. How many ranges there are grows with the table and changes no result.

    docs without a text column bring their size column instead, and may bring the text's MD5 as column tie.

    Null source: a source of its own, last. Null text: size 0. Null doc_id: allowed. Rows equal in id and text are
    interchangeable. Sources whose sizes are all 0: target 0, nothing taken. Extra columns are kept as they are,
    whatever their names; the operator's own columns are size, source_size, target, copies, taken, and replace columns
    of those names. Reruns give the same rows.
    """
    own = ("size", "source_size", "target", "copies", "taken")
    whole = "text" in docs.columns
    keep = [c for c in docs.columns if c not in own and (whole or c != "tie")]
    size = n_words(F.col("text")) if whole else F.col("size")
    tie = F.md5(F.col("text").cast("binary")) if whole else F.col("tie") if "tie" in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), "source", size.alias("size"), place(F.col("doc_id").cast("string"), F.lit(str(seed)), tie).alias("h"))
    ranges = max(LEAST_RANGES, -(-docs.count() // RANGE_ROWS))
    d = d.withColumn("range", F.floor(F.col("h") / (PLACES / ranges)))
    cells = saved(d.groupBy("source", "size", "range").agg(F.count("*").alias("n")), "mix-cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(sizes, weights, total_share, most)
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    targets = targets.withColumn("offset", place(F.lit(f"offset {seed}"), "source") / float(PLACES))
    # the order within a source: size, then hash; each cell's first rank
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    upto = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    by_size = by_size.select("source", "size", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    upto = W.partitionBy("source", "size").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    first = cells.select("source", "size", "range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("within"))
    first = first.alias("f").join(by_size.alias("b"), [F.col(f"f.{x}").eqNullSafe(F.col(f"b.{x}")) for x in ("source", "size")]).select("f.*", "before")
    first = first.alias("f").join(targets.alias("t"), F.col("f.source").eqNullSafe(F.col("t.source")))
    first = first.select("f.source", "f.size", "f.range", (F.col("before") + F.col("within")).alias("first"), "source_size", "target", "rate", "offset")
    ranked = d.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "range").orderBy("h")))
    j = ranked.alias("d").join(first.alias("f"), [F.col(f"d.{x}").eqNullSafe(F.col(f"f.{x}")) for x in ("source", "size", "range")])
    at = F.col("first") + F.col("rank")
    copies = (F.floor(at * F.col("rate") + F.col("offset")) - F.floor((at - 1) * F.col("rate") + F.col("offset"))).cast("long")
    out = j.select("row", F.col("d.size").alias("size"), "source_size", "target", F.least(copies, F.lit(int(most))).alias("copies"))
    return out.select(*(F.col("row")[c].alias(c) for c in keep), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed rows, each once per copy taken."""
    copies = F.array_repeat(F.struct(*(F.col(f"`{c}`") for c in mixed.columns)), F.col("copies").cast("int"))
    return mixed.filter("copies > 0").select(F.inline(copies))
