from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks.plans import counts


def test_sketched_values_are_digests(spark, sf_dir, monkeypatch):
    """Values are saved, joined and counted by grouping sets as 32 bytes each, however long they are."""
    made, keep = {}, counts.saved
    monkeypatch.setattr(counts, "saved", lambda df, name: made.setdefault(name, df) and keep(df, name))
    counts.value_sketches(spark, sf_dir)
    assert made["field-values"].schema["value"].dataType.simpleString() == "binary"
    assert made["field-values"].agg(F.max(F.octet_length("value"))).first()[0] == 32
