"""What the readers of media containers yield: one Unit for each part of a file."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

_LONG = T.LongType()
#: Spark type of a file's units.
UNITS = T.ArrayType(
    T.StructType()
    .add("id", "string")
    .add("role", "string")
    .add("size", _LONG)
    .add("start", _LONG)
    .add("body", _LONG)
    .add("stop", _LONG)
    .add("zones", T.ArrayType(T.StructType().add("at", _LONG).add("len", _LONG)))
)
SCANNED = T.StructType().add("units", UNITS).add("error", "string")


class Malformed(ValueError):
    """The file breaks its format's rules."""


class Unit(NamedTuple):
    """A part of a file.

    id and size are what reports show, role is what policies look up. The part lies in start..stop with its payload
    from body on; zones are the byte ranges that hold its content, where they are fewer than body..stop.
    """

    id: str
    role: str
    size: int
    start: int
    body: int
    stop: int
    zones: tuple[tuple[int, int], ...] = ()


def fourcc(data: bytes, at: int) -> str:
    return data[at : at + 4].decode("latin-1")
