"""Streams of files and texts: each micro-batch goes through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sieveworks.operators import batch, textclean
from sieveworks.operators.textclean import TextOptions
from sieveworks.sources.files import SCHEMA, bounded_batches, supported


def strip_stream(spark: SparkSession, source: str, out: str, log: str, checkpoint: str, options: TextOptions = textclean.DEFAULT) -> StreamingQuery:
    """Cleans files as they arrive in the folder source, into out; statuses go to the Parquet folder log, one per batch.

    Takes what is there and ends. A batch that is run again after a failure overwrites its own files and log.
    """
    bounded_batches(spark)
    arriving = spark.readStream.format("binaryFile").schema(SCHEMA).load(source)

    def one(rows: DataFrame, number: int) -> None:
        done = batch.process(supported(rows), out, options, overwrite=True)
        done.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clean_stream(texts: DataFrame, key: str, text: str, out: str, checkpoint: str, options: TextOptions = textclean.DEFAULT) -> StreamingQuery:
    """Cleans a streaming DataFrame's texts into the Parquet folder out, one sub-folder per batch; key identifies a row of a batch."""

    def one(rows: DataFrame, number: int) -> None:
        textclean.clean(rows, key, text, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
