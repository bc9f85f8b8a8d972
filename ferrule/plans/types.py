"""Canonical column types: SQL type text → canonical kind → Spark type.

Parsing is case-insensitive, keeps the original text, and raises on an unknown name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

# The fourteen canonical kinds and the SQL names accepted for each.
KINDS = ("BOOLEAN", "INT16", "INT32", "INT64", "FLOAT32", "FLOAT64", "DECIMAL", "STRING",
         "DATE", "TIME", "TIMESTAMP", "UUID", "JSON", "BYTES")
_SIMPLE = {
    "boolean": "BOOLEAN", "bool": "BOOLEAN",
    "smallint": "INT16", "int2": "INT16",
    "integer": "INT32", "int": "INT32", "int4": "INT32",
    "bigint": "INT64", "int8": "INT64",
    "real": "FLOAT32", "float4": "FLOAT32",
    "double precision": "FLOAT64", "float8": "FLOAT64",
    "date": "DATE",
    "uuid": "UUID",
    "json": "JSON", "jsonb": "JSON",
    "bytea": "BYTES",
}
_TEXT = ("text", "varchar", "character varying", "char", "character", "bpchar")
DEFAULT_DECIMAL = (38, 9)


class TypeParseError(ValueError):
    pass


@dataclass(frozen=True)
class CanonicalType:
    kind: str
    precision: int | None = None
    scale: int | None = None
    length: int | None = None
    tz: bool = False
    source: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise TypeParseError(f"unknown canonical kind {self.kind!r}")
        if self.kind == "DECIMAL" and (self.precision is None or self.scale is None):
            raise TypeParseError("DECIMAL needs both precision and scale")

    def spark_type(self) -> T.DataType:
        k = self.kind
        if k == "BOOLEAN":
            return T.BooleanType()
        if k == "INT16":
            return T.ShortType()
        if k == "INT32":
            return T.IntegerType()
        if k == "INT64":
            return T.LongType()
        if k == "FLOAT32":
            return T.FloatType()
        if k == "FLOAT64":
            return T.DoubleType()
        if k == "DECIMAL":
            return T.DecimalType(self.precision, self.scale)
        if k in ("STRING", "UUID", "JSON"):
            return T.StringType()
        if k == "DATE":
            return T.DateType()
        if k == "TIME":
            return T.StringType()  # kept as ISO text unless the session enables TIME
        if k == "TIMESTAMP":
            return T.TimestampType() if self.tz else T.TimestampNTZType()
        return T.BinaryType()

    def to_dict(self) -> dict:
        return {"kind": self.kind, "precision": self.precision, "scale": self.scale,
                "length": self.length, "tz": self.tz, "source": self.source}


def parse_sql_type(text: str) -> CanonicalType:
    """SQL type text → canonical type.  Unknown names raise, never guessed."""
    src = text
    t = " ".join(text.strip().lower().split())
    if not t:
        raise TypeParseError("empty type name")
    if t.startswith("timestamp"):
        tz = "with time zone" in t or t.startswith("timestamptz")
        return CanonicalType("TIMESTAMP", tz=tz, source=src)
    if t.startswith("time"):
        return CanonicalType("TIME", source=src)
    m = re.fullmatch(r"(numeric|decimal)\s*(\(\s*(\d+)\s*(,\s*(\d+)\s*)?\))?", t)
    if m:
        if m.group(3) is None:
            p, s = DEFAULT_DECIMAL
        else:
            p, s = int(m.group(3)), int(m.group(5) or 0)
        return CanonicalType("DECIMAL", precision=p, scale=s, source=src)
    m = re.fullmatch(r"([a-z ]+?)\s*(\(\s*(\d+)\s*\))?", t)
    if m:
        base, n = m.group(1).strip(), m.group(3)
        if base in _TEXT:
            return CanonicalType("STRING", length=int(n) if n else None, source=src)
        if base in _SIMPLE and n is None:
            return CanonicalType(_SIMPLE[base], source=src)
    raise TypeParseError(f"unknown SQL type {text!r}")


def from_spark(dtype: T.DataType) -> CanonicalType:
    """Canonical type of an existing Spark column (for stored tables and twins)."""
    if isinstance(dtype, T.BooleanType):
        return CanonicalType("BOOLEAN")
    if isinstance(dtype, (T.ByteType, T.ShortType)):
        return CanonicalType("INT16")
    if isinstance(dtype, T.IntegerType):
        return CanonicalType("INT32")
    if isinstance(dtype, T.LongType):
        return CanonicalType("INT64")
    if isinstance(dtype, T.FloatType):
        return CanonicalType("FLOAT32")
    if isinstance(dtype, T.DoubleType):
        return CanonicalType("FLOAT64")
    if isinstance(dtype, T.DecimalType):
        return CanonicalType("DECIMAL", precision=dtype.precision, scale=dtype.scale)
    if isinstance(dtype, T.StringType):
        return CanonicalType("STRING")
    if isinstance(dtype, T.DateType):
        return CanonicalType("DATE")
    if isinstance(dtype, T.TimestampNTZType):
        return CanonicalType("TIMESTAMP", tz=False)
    if isinstance(dtype, T.TimestampType):
        return CanonicalType("TIMESTAMP", tz=True)
    if isinstance(dtype, T.BinaryType):
        return CanonicalType("BYTES")
    raise TypeParseError(f"no canonical kind for Spark type {dtype.simpleString()}")
