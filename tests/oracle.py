"""Compares registered queries with their DuckDB SQL: ``python tests/oracle.py SF_DIR [NAME...]``."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb


def plain(value):
    """One form for both engines' values."""
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat(" ").removesuffix("+00:00")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def connect(sf_dir):
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


def compare(spark, sf_dir, query, sql, db):
    """None where both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    found = db.execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    if got == want:
        return None
    if got[0] != want[0] or len(got[1]) != len(want[1]):
        return f"{got[0]} {len(got[1])} rows; SQL {want[0]} {len(want[1])} rows"
    return str(next((g, w) for g, w in zip(got[1], want[1], strict=True) if g != w))[:800]


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    queries, sqls, base = entry.queries(), entry.oracle_sql(), connect(sys.argv[1])
    for name in sys.argv[2:] or sqls:
        print(name, compare(session, sys.argv[1], queries[name], sqls[name], base) or "ok", flush=True)
