"""Registered queries of distinct metadata values by sketches and of sessions of events, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import inspect, sketches
from sieveworks.plans import media
from sieveworks.sources.shared import saved
from sieveworks.streaming.sessions import sessions

Query = Callable[[SparkSession, str], DataFrame]
#: The field that holds the whole text, by format.
NAMES = {"png": "Title", "wav": "INAM"}
BY = ("format", "source")
SETS = (("format", "source"), ("format",), ("source",), ())


def value_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of metadata by format and source, by either and in all: exact counts, and whether saved and merged sketches come near.

    The sketches of each format and source are saved and merged; only the exact counts, which show how near the
    estimates are, go over the values again. Values are told by their SHA-256, so that none is joined, saved or
    shuffled whole, once for each grouping set.
    """
    found = None
    for format, name in NAMES.items():
        rows = inspect.fields(media.media_files(spark, sf_dir, format), "doc_id").filter(F.col("name") == name).select("doc_id", "format", F.unhex(F.sha2("value", 256)).alias("value"))
        found = rows if found is None else found.unionByName(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    values = saved(found.join(docs, "doc_id").select("format", "source", "value"), "field-values")
    kept = saved(sketches.sketch(values, BY, "value"), "field-sketches")
    merged = sketches.cube(kept, SETS, BY).withColumn("estimate", sketches.estimate())
    exact = values.distinct().groupingSets([[F.col(c) for c in s] for s in SETS], *map(F.col, BY))
    exact = exact.agg(F.grouping_id(*map(F.col, BY)).cast("int").alias("level"), F.count_distinct("value").alias("n_values"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*BY, "level")]
    near = F.abs(F.col("estimate") - F.col("n_values")) <= F.greatest(F.lit(1.0), F.col("n_values") * sketches.most_error())
    return merged.alias("m").join(exact.alias("e"), same).select("m.format", "m.source", "m.level", "rows", "n_values", near.alias("near"))


def _values_sql() -> str:
    each = " UNION ALL ".join(f"SELECT '{f}' AS format, doc_id, value FROM ({media.ORACLE_SQL[f'{f}_inspect']})" for f in NAMES)
    sets = ", ".join(f"({', '.join(s)})" for s in SETS)
    return f"""SELECT format, source, grouping({', '.join(BY)})::int AS level, count(value) AS rows, count(DISTINCT value) AS n_values, true AS near
        FROM (SELECT v.format, d.source, v.value FROM ({each}) v JOIN documents d USING (doc_id)) GROUP BY GROUPING SETS ({sets})"""


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user's events, twelve hours apart at most, and the code points planted in their properties: the batch twin of the stream."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    planted = F.concat(F.coalesce("props", F.lit("")), F.repeat(F.lit("\u200b"), (F.col("event_id") % 4).cast("int")))
    found = sessions(events.withColumn("planted", planted), "event_id", "user_id", "ts", "planted", "12 hours", "1 hour")
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("opened", "closed")]
    return found.select("user_id", *shown, "events", "suspicious")


_SESSIONS_SQL = """
WITH marked AS (SELECT user_id, event_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 12 HOUR, true)::int AS opens FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS opened, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS closed,
    count(*) AS events, sum(event_id % 4)::bigint AS suspicious
FROM numbered GROUP BY user_id, session"""

QUERIES: dict[str, Query] = {"value_sketches": value_sketches, "event_sessions": event_sessions}
ORACLE_SQL = {"value_sketches": _values_sql(), "event_sessions": _SESSIONS_SQL}
