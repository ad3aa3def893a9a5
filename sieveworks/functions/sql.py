"""The library's functions under SQL names."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sieveworks.operators.inspect import scan_fields
from sieveworks.operators.strip import READERS, policy_table, scan_units, splice
from sieveworks.sources.fields import FIELD_READERS, rows, shown
from sieveworks.sources.formats import extension_table
from sieveworks.sources.units import Malformed


@udtf(returnType="seq int, id string, role string, size bigint, start bigint, body bigint, stop bigint, error string")
class ScanChunks:
    """The parts of one file as rows, up to where it breaks off; there a last row says why (its other columns are null)."""

    def eval(self, format: str, content: bytes) -> Iterator[tuple]:
        seq = 0
        try:
            for seq, u in enumerate(READERS[format](bytes(content)) if content is not None and format in READERS else ()):
                yield seq, u.id, u.role, u.size, u.start, u.body, u.stop, None
        except (Malformed, RecursionError) as why:
            yield seq + 1, None, None, None, None, None, None, str(why)


@udtf(returnType="seq int, parent int, level int, section string, place string, name string, value string, size bigint, detail map<string,string>")
class ScanFields:
    """The metadata of one file as rows in the order of its tree, bytes as text; parent is the seq of the row above, -1 the file."""

    def eval(self, format: str, content: bytes) -> Iterator[tuple]:
        try:
            for seq, f in enumerate(rows(FIELD_READERS[format](bytes(content))) if content is not None and format in FIELD_READERS else ()):
                yield seq, f["parent"], f["level"], f["section"], f["path"], shown(f["name"]), None if f["raw"] is None else shown(f["raw"]), f["size"], f["detail"]
        except (Malformed, RecursionError):
            return


def register(spark: SparkSession) -> None:
    """scan_units(format, content), scan_fields(format, content), splice(content, edits), and views of the fixed tables.

    As table functions, for LATERAL: chunks_of(format, content) and fields_of(format, content), a row for each part or field.
    """
    spark.udf.register("scan_units", scan_units)
    spark.udf.register("scan_fields", scan_fields)
    spark.udf.register("splice", splice)
    spark.udtf.register("chunks_of", ScanChunks)
    spark.udtf.register("fields_of", ScanFields)
    policy_table(spark).createOrReplaceTempView("strip_policy")
    extension_table(spark).createOrReplaceTempView("file_formats")
