"""Distinct counts by HyperLogLog sketches that are saved by group and merged later, without the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sketch has 2^LG_K buckets of some bits: 8 KB at most at 12.
LG_K = 12


def most_error(lg_k: int = LG_K) -> float:
    """Three standard errors of a merged sketch, as a share of the count; one estimate in some 370 lies beyond."""
    return 3 * 1.04 / math.sqrt(1 << lg_k)


def sketch(rows: DataFrame, by: Sequence[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """(by, sketch, rows): a sketch of the distinct non-null values of each group, and how many they are with repeats.

    value is a string, binary, int or long. Spark sketches each partition before the shuffle, so a group travels as one
    sketch a partition, however hot it is. A group of nulls alone has an empty sketch; no row gives no group. Null keys
    are a group.
    """
    _own_names(by)
    return rows.groupBy(*map(_named, by)).agg(F.hll_sketch_agg(_named(value), F.lit(lg_k)).alias("sketch"), F.count(_named(value)).alias("rows"))


def merge(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, sketch, rows): the sketches of equal keys as one. All must be of one lg_k, or this fails; none gives no row, but one empty row without keys."""
    _own_names(by)
    return sketches.groupBy(*map(_named, by)).agg(*_merged())


def cube(sketches: DataFrame, sets: Sequence[Sequence[str]], by: Sequence[str]) -> DataFrame:
    """(by, level, sketch, rows): the sketches merged for each of the grouping sets.

    level has a bit for each column of by, the first the highest, set where the column is not of the grouping set: so a
    null key is told from a column that is left out. Only sketches are expanded, not the rows they are of.
    """
    _own_names((*by, "level"), reserved=("sketch", "rows"))
    if not by or any(c not in by for s in sets for c in s):
        raise ValueError("the grouping sets must be of columns of by")
    grouped = sketches.groupingSets([[_named(c) for c in s] for s in sets], *map(_named, by))
    return grouped.agg(F.grouping_id(*map(_named, by)).cast("int").alias("level"), *_merged())


def estimate(column: str = "sketch") -> Column:
    """The estimated number of distinct values."""
    return F.hll_sketch_estimate(column)


def _merged() -> tuple[Column, Column]:
    return F.hll_union_agg("sketch", F.lit(False)).alias("sketch"), F.sum("rows").alias("rows")


def _named(column: str) -> Column:
    return F.col(f"`{column}`")


def _own_names(by: Sequence[str], reserved: Sequence[str] = ("sketch", "rows")) -> None:
    clash = [c for c in by if c in reserved] + [c for k, c in enumerate(by) if c in by[:k]]
    if clash:
        raise ValueError(f"columns of these names can't be keys: {', '.join(clash)}")
