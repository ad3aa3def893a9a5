"""Joins of ranges that overlap, by bins of their own length's scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(start: Column, stop: Column) -> Column:
    """The least k for which 2^k is at least the range's length."""
    return F.when(stop - start > 1, F.length(F.bin(stop - start - 1))).otherwise(0)


def _binned(rows: DataFrame, level: Column) -> DataFrame:
    """A row for each bin of 2^level that the range touches: two at most where the level is its own or higher."""
    leveled = rows.withColumn("_at", level)
    low = lambda x: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col("_at"))).cast("long")
    return leveled.withColumn("_bin", F.explode(F.array_distinct(F.array(low("start"), low("_last")))))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, l, r): the pairs of rows, as structs, that agree in ``on`` and whose ranges start..stop overlap, each pair once.

    A range lies in at most two bins of the power of two that its length calls for. The longer of two meets the
    shorter in its own bins, to which the shorter is dealt for each level above its own that occurs (64 at most, a
    list of small numbers). So long ranges aren't cut into many bins, short ones don't meet in large ones by the
    thousand, and the join is an equality join of (on, level, bin), which Spark shuffles and splits; there is no
    product of the sides.

    start and stop are longs of less than 2^52, 0 or more; stop isn't in the range. Empty ranges and null bounds
    overlap nothing. Null values of ``on`` agree with each other.
    """

    def sided(df: DataFrame, name: str) -> DataFrame:
        whole = df.filter(F.col("stop") > F.col("start"))
        return whole.select(*on, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name), F.col("start").cast("long").alias("start"), (F.col("stop") - 1).cast("long").alias("_last"), _level(F.col("start"), F.col("stop")).alias("_own"))

    sides = {"l": sided(left, "l"), "r": sided(right, "r")}
    occurring = sorted(r[0] for r in sides["l"].select("_own").union(sides["r"].select("_own")).distinct().collect())
    levels = F.array(*map(F.lit, occurring)).cast("array<int>")

    def met(longer: str, shorter: str, equal: bool) -> DataFrame:
        own = _binned(sides[longer], F.col("_own"))
        above = F.explode(F.filter(levels, lambda k: k >= F.col("_own") if equal else k > F.col("_own")))
        other = _binned(sides[shorter].withColumn("_up", above), F.col("_up"))
        keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*on, "_at", "_bin")]
        # the sides are several times their tables once they are dealt, which Spark's estimate of their size doesn't see: broadcast, they fill the driver
        pairs = own.alias("a").hint("merge").join(other.alias("b"), keys)
        first = F.floor(F.greatest("a.start", "b.start") / F.pow(F.lit(2.0), F.col("a._at"))).cast("long") == F.col("a._bin")
        return pairs.filter((F.col("a.start") <= F.col("b._last")) & (F.col("b.start") <= F.col("a._last")) & first).select(*(F.col(f"a.{c}") for c in on), "l", "r")

    return met("l", "r", True).unionByName(met("r", "l", False))
