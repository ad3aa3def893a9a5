"""The registered queries of the hygiene engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveworks.plans import counts, media, planted, text, trees

FLAGSHIP = "text_clean"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = text.QUERIES | media.QUERIES | trees.QUERIES | planted.QUERIES | counts.QUERIES

ORACLE_SQL: dict[str, str] = text.ORACLE_SQL | media.ORACLE_SQL | trees.ORACLE_SQL | planted.ORACLE_SQL | counts.ORACLE_SQL
