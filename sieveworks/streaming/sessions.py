"""Sessions of texts that arrive with event times: how many suspicious code points each session brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveworks.functions.codepoints import STRIPPED, regex_class


def suspicious(text: Column) -> Column:
    """How many code points of a text are of those that cleaning drops unless their neighbours call for them; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[{regex_class(STRIPPED)}]")), F.lit(0)).cast("long")


def sessions(events: DataFrame, id: str, key: str, time: str, text: str, gap: str, late: str) -> DataFrame:
    """(key, opened, closed, events, suspicious) of each session: rows of a key less than gap apart, or just gap.

    The same for a stream and for a table; closed is gap after the session's last row. Rows of an id that was there
    before count once. In a stream, rows more than `late` behind the newest time seen are dropped, a copy is known
    for that long, and a session is given out when nothing that is not late can join it; so state is bounded by what
    arrives within late and gap. A table has no late rows. Rows whose time is null are of no session, and a null id or
    key is a value like any other. Only numbers are shuffled: texts are counted before.
    """
    rows = events.select(F.col(f"`{id}`").alias("id"), F.col(f"`{key}`").alias("key"), F.col(f"`{time}`").alias("time"), suspicious(F.col(f"`{text}`")).alias("n")).filter("time is not null")
    once = rows.withWatermark("time", late).dropDuplicatesWithinWatermark(["id"]) if events.isStreaming else rows.dropDuplicates(["id"])
    made = once.groupBy("key", F.session_window("time", gap).alias("span")).agg(F.count("*").alias("events"), F.sum("n").alias("suspicious"))
    return made.select(F.col("key").alias(key), F.col("span.start").alias("opened"), F.col("span.end").alias("closed"), "events", "suspicious")


def session_stream(events: DataFrame, id: str, key: str, time: str, text: str, out: str, checkpoint: str, gap: str = "10 minutes", late: str = "1 hour") -> StreamingQuery:
    """Appends the sessions of a streaming DataFrame to the Parquet folder out, each once, and ends with what is there.

    Run again with the same checkpoint it goes on from its state; files of a batch that failed are not read, as the
    folder's own log names those that count.
    """
    made = sessions(events, id, key, time, text, gap, late)
    return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
