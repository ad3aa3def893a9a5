"""Shared parts of the training-data operators: the shared folder, lineage cuts, word rules and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that a Python worker handles at once, and bytes of the Arrow batches that bring them.
ROWS, BATCH_BYTES = 500, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where neither it nor a checkpoint folder is set, a local session (tests) gets a temporary folder; a cluster, whose
    executors don't share one, fails.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='sieveworks-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends in replicated files, columns stay prunable."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of texts by bytes; the row setting is left to the user."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sliced(batches: Iterator[pd.DataFrame], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    """The batches in parts of at most so many rows."""
    for pdf in batches:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k : k + rows]


def gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches, small ones put together until there are so many rows."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """How many runs of ``[^\\x20\\x09-\\x0D]+`` a text holds; null: 0.

    With separators collapsed to one space and the ends trimmed, words are one more than spaces.
    """
    flat = F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(text.isNull() | (flat == ""), F.lit(0)).otherwise(spaces + 1).cast("long")


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's edges, a bounded chunk at a time; each chunk becomes stars that join the same nodes."""
    for pdf in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while (up := parent.get(x, x)) != root:
                parent[x] = root
                x = up
            return root

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        rows = [(x, find(x)) for x in list(parent)]
        yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges from a node a to a smaller node b are stars: each a has one b, and no b is an a."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).filter("up > 1 or up = 1 and n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a long, b long) as (node, component), component the smallest node.

    Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014), written
    as partially aggregated minima and joins, so that a node with very many edges is never gathered in one task.
    Every step is saved; they stop as soon as the edges are stars, which one grouping by node tells: a step that changes
    nothing is never run, as its jobs cost the driver more than such small tables cost the tasks. Nulls and self-loops
    are ignored; no edge gives no row.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a != b")
    e = saved(e.mapInPandas(_contract, "a long, b long").distinct(), "component-edges")
    while not _stars(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = saved(small.filter("a != b").distinct(), "component-edges")
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(members.select(F.col("component").alias("node"), "component").distinct())
