"""Per-type text renderers as Column expressions (CSV, JSON lines, SQL literals, COPY text).

Conventions (fixed values of the output formats):

- CSV: NULL = empty field; strings, temporals and bytes always double-quoted with ``"`` doubled;
  numbers bare; booleans ``true``/``false``; bytes as lowercase hex; temporals with a space
  separator.  Header names are quoted (embedded quotes doubled).
- JSON lines: keys in column order, ``null`` kept, decimals and bytes as strings, temporals ISO
  (``T`` separator), ``", "`` and ``": "`` separators.
- SQL: ``NULL``/``TRUE``/``FALSE``; numbers bare; bytes ``X'..'``; text and ISO temporals
  single-quoted with ``'`` doubled; a NUL byte or a non-finite float raises.
- COPY text: tab separated, ``\\N`` for NULL, backslash/tab/LF/CR escaped, ``t``/``f``, floats
  ``NaN``/``Infinity``/``-Infinity``, timestamps with a space and ``+00:00`` when zoned,
  bytes ``\\x`` + hex; a NUL byte raises.

Fractional seconds are printed (6 digits) only when non-zero; floats follow the shortest
round-trip text with positional notation for 1e-4 ≤ |x| < 1e16 and ``1e-05``/``1e+16`` style
outside.  The digits come from the JVM's double-to-text conversion: on JDK < 19 it is not always
the shortest (one extra digit for some values, mostly |x| ≥ 1e16, some powers of two and
subnormals); the text then still parses back to the same double.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
TEXT_TYPES = (T.StringType, T.CharType, T.VarcharType)


def _s(col: Column) -> Column:
    return col.cast("string")


def float_text(col: Column) -> Column:
    """Shortest round-trip text of a float in positional/exponent form (NaN → nan, ±inf)."""
    s = _s(col.cast("double"))
    pat = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign = F.regexp_extract(s, pat, 1)
    digits = F.concat(F.regexp_extract(s, pat, 2),
                      F.regexp_replace(F.regexp_extract(s, pat, 3), "0+$", ""))
    e = F.regexp_extract(s, pat, 4).cast("int")
    nd = F.length(digits)
    positional_big = F.when(nd - 1 <= e, F.concat(digits, F.repeat(F.lit("0"), e - (nd - 1)), F.lit(".0"))) \
        .otherwise(F.concat(digits.substr(F.lit(1), e + 1), F.lit("."),
                            digits.substr(e + 2, F.lit(1 << 20))))
    positional_small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    mant = F.when(nd > 1, F.concat(digits.substr(1, 1), F.lit("."), digits.substr(F.lit(2), nd)))\
        .otherwise(digits)
    expo = F.concat(mant, F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
                    F.when(F.abs(e) < 10, F.concat(F.lit("0"), F.abs(e).cast("string")))
                    .otherwise(F.abs(e).cast("string")))  # lpad would cut 3-digit exponents
    body = (F.when((e >= 16) | (e < -4), expo)
            .when(e >= 0, positional_big).otherwise(positional_small))
    x = col.cast("double")
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
            .when(s.contains("E"), F.concat(sign, body)).otherwise(s))


def _frac(ts_utc: Column) -> Column:
    micros = F.pmod(F.unix_micros(ts_utc), F.lit(1_000_000))
    return F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))) \
        .otherwise(F.lit(""))


def temporal_text(col: Column, dtype: T.DataType, sep: str = "T") -> Column:
    """ISO text of a date or timestamp (``+00:00`` for zoned timestamps; UTC session)."""
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    ts = col.cast("timestamp")
    base = F.concat(F.date_format(ts, f"yyyy-MM-dd'{sep}'HH:mm:ss"), _frac(ts))
    if isinstance(dtype, T.TimestampType):
        return F.concat(base, F.lit("+00:00"))
    return base


def _is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _reject_nul(text: Column, what: str) -> Column:
    return F.when(text.contains("\x00"),
                  F.raise_error(F.lit(f"value contains NUL byte, not representable in {what}"))
                  ).otherwise(text)


# --- CSV ------------------------------------------------------------------------------------

def _quote_csv(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_field(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        v = F.when(col, F.lit("true")).otherwise(F.lit("false"))
    elif isinstance(dtype, INT_TYPES) or isinstance(dtype, T.DecimalType):
        v = _s(col)
    elif isinstance(dtype, FLOAT_TYPES):
        v = float_text(col)
    elif isinstance(dtype, T.BinaryType):
        v = _quote_csv(F.lower(F.hex(col)))
    elif _is_temporal(dtype):
        v = _quote_csv(temporal_text(col, dtype, " "))
    else:
        v = _quote_csv(_s(col))
    return F.when(col.isNull(), F.lit("")).otherwise(v)


def csv_header(columns: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' for c in columns)


def csv_line(schema: T.StructType) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(f.name), f.dataType) for f in schema.fields])


# --- JSON lines -----------------------------------------------------------------------------

def json_string(text: Column) -> Column:
    """A JSON string literal (escaped) for a text Column."""
    arr = F.to_json(F.array(text))
    return arr.substr(F.lit(2), F.length(arr) - 2)


def json_value(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        v = F.when(col, F.lit("true")).otherwise(F.lit("false"))
    elif isinstance(dtype, INT_TYPES):
        v = _s(col)
    elif isinstance(dtype, FLOAT_TYPES):
        x = col.cast("double")
        v = (F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("Infinity"))
             .when(x == float("-inf"), F.lit("-Infinity")).otherwise(float_text(col)))
    elif isinstance(dtype, T.DecimalType):
        v = F.concat(F.lit('"'), _s(col), F.lit('"'))
    elif isinstance(dtype, T.BinaryType):
        v = F.concat(F.lit('"'), F.lower(F.hex(col)), F.lit('"'))
    elif _is_temporal(dtype):
        v = F.concat(F.lit('"'), temporal_text(col, dtype, "T"), F.lit('"'))
    else:
        v = json_string(_s(col))
    return F.when(col.isNull(), F.lit("null")).otherwise(v)


def json_line(schema: T.StructType) -> Column:
    parts = []
    for i, f in enumerate(schema.fields):
        key = json.dumps(f.name, ensure_ascii=False) + ": "
        parts += [F.lit(("" if i == 0 else ", ") + key), json_value(F.col(f.name), f.dataType)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


# --- SQL literals ---------------------------------------------------------------------------

def sql_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sql_literal(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        v = F.when(col, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif isinstance(dtype, INT_TYPES) or isinstance(dtype, T.DecimalType):
        v = _s(col)
    elif isinstance(dtype, FLOAT_TYPES):
        x = col.cast("double")
        v = F.when(F.isnan(x) | (F.abs(x) == float("inf")),
                   F.raise_error(F.lit("non-finite float is not representable in a SQL literal"))
                   ).otherwise(float_text(col))
    elif isinstance(dtype, T.BinaryType):
        v = F.concat(F.lit("X'"), F.lower(F.hex(col)), F.lit("'"))
    else:
        text = temporal_text(col, dtype, "T") if _is_temporal(dtype) else _s(col)
        v = F.concat(F.lit("'"), F.replace(_reject_nul(text, "a SQL literal"), F.lit("'"), F.lit("''")),
                     F.lit("'"))
    return F.when(col.isNull(), F.lit("NULL")).otherwise(v)


def sql_tuple(schema: T.StructType) -> Column:
    return F.concat(F.lit("  ("), F.concat_ws(", ", *[sql_literal(F.col(f.name), f.dataType)
                                                       for f in schema.fields]), F.lit(")"))


# --- COPY text ------------------------------------------------------------------------------

def copy_escape(text: Column) -> Column:
    t = _reject_nul(text, "COPY text")
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def copy_field(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        v = F.when(col, F.lit("t")).otherwise(F.lit("f"))
    elif isinstance(dtype, INT_TYPES) or isinstance(dtype, T.DecimalType):
        v = _s(col)
    elif isinstance(dtype, FLOAT_TYPES):
        x = col.cast("double")
        v = (F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("Infinity"))
             .when(x == float("-inf"), F.lit("-Infinity")).otherwise(float_text(col)))
    elif isinstance(dtype, T.BinaryType):
        v = F.concat(F.lit("\\x"), F.lower(F.hex(col)))
    elif _is_temporal(dtype):
        v = temporal_text(col, dtype, " ")
    elif isinstance(dtype, TEXT_TYPES):
        v = _s(col)
    else:
        raise ValueError(f"cannot COPY-encode type {dtype.simpleString()}")
    return F.when(col.isNull(), F.lit("\\N")).otherwise(copy_escape(v))


def copy_line(schema: T.StructType) -> Column:
    return F.concat_ws("\t", *[copy_field(F.col(f.name), f.dataType) for f in schema.fields])


def json_safe(col: Column, dtype: T.DataType) -> Column:
    """JSON-safe display value for previews: decimals exact text, bytes hex, temporals ISO."""
    if isinstance(dtype, T.DecimalType):
        return _s(col)
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(col))
    if _is_temporal(dtype):
        return temporal_text(col, dtype, "T")
    return col
