"""Typed readers: JSON lines bound to declared column types, and declared-schema casts.

JSON lines are read with an all-string schema (Spark keeps a number's text for a string field,
so decimals never pass through binary floats) and each column is then cast to its declared
type: integers and decimals from text, booleans, ISO dates and timestamps (an offset is
converted to UTC wall time for columns without a zone), hex bytes.  Blank lines are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.types import CanonicalType, parse_sql_type


#: Fixed value: a time of day (hours and minutes, seconds, fraction).
TIME_TEXT = r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?$"


def _bind(text: Column, ct: CanonicalType, strict: bool) -> Column:
    def cast(c: Column, t: T.DataType) -> Column:
        return c.cast(t) if strict else c.try_cast(t)

    k = ct.kind
    if k == "TIME":
        good = text.isNull() | text.rlike(TIME_TEXT)
        return F.when(~good, F.raise_error(F.concat(F.lit("not a time of day: "), text)).cast("string")).otherwise(text) \
            if strict else F.when(good, text)
    if k in ("STRING", "UUID", "JSON"):
        return text
    if k == "BYTES":
        data = F.unhex(text)
        return F.when(text.isNotNull() & data.isNull(), F.raise_error(F.concat(F.lit("not hex: "), text)).cast("binary")) \
            .otherwise(data) if strict else data
    if k == "BOOLEAN":
        return cast(F.lower(text), T.BooleanType())
    if k == "DATE":
        return cast(text, T.DateType())
    if k == "TIMESTAMP":
        zoned = cast(text, T.TimestampType())  # an explicit offset is honoured, else UTC session
        return zoned if ct.tz else zoned.cast(T.TimestampNTZType())
    return cast(text, ct.spark_type())


def read_jsonl(spark: SparkSession, path: str, columns: dict[str, str | CanonicalType],
               strict: bool = True) -> DataFrame:
    """JSON lines → typed DataFrame with ``columns`` ({name: SQL type or canonical type}) in order."""
    cts = {n: (t if isinstance(t, CanonicalType) else parse_sql_type(t)) for n, t in columns.items()}
    # a line that is no JSON object stops a strict read; otherwise it is a row of NULLs, and
    # ``corrupt_lines`` gives it back
    raw = (spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in cts]))
           .option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path))
    return raw.select(*[_bind(F.col(n), ct, strict).alias(n) for n, ct in cts.items()])


def corrupt_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(line): the non-blank lines that are not JSON objects."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*columns, "_corrupt"]])
    rows = spark.read.text(path).where(F.trim("value") != "").select(
        "value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.where(F.col("r._corrupt").isNotNull()).select(F.col("value").alias("line"))


def _converted(c: Column, ct: CanonicalType) -> Column:
    """A value as its declared type, NULL if it is none."""
    if ct.kind == "TIME":
        text = c.cast("string")
        return F.when(text.rlike(TIME_TEXT), text)
    return c.try_cast(ct.spark_type())


def cast_to_schema(df: DataFrame, declared: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Cast columns to declared SQL types; what does not convert is NULL.

    Returns (cast DataFrame, rejects) where rejects has one row per declared column with the
    number of non-null values that did not convert (one aggregate pass); ``reject_rows`` has those
    values themselves."""
    cts = {n: parse_sql_type(t) for n, t in declared.items()}
    cast = df.select(*[_converted(F.col(c), cts[c]).alias(c) if c in cts else F.col(c) for c in df.columns])
    counts = df.agg(*[F.count_if(F.col(n).isNotNull() & _converted(F.col(n), ct).isNull()).alias(n) for n, ct in cts.items()])
    rejects = counts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.lit(declared[n]).alias("declared_type"),
                 F.col(n).alias("rejected")) for n in cts])))
    return cast, rejects


def reject_rows(df: DataFrame, declared: dict[str, str], key: list[str]) -> DataFrame:
    """A row for every value that does not convert: the ``key`` columns, column_name, declared_type, value
    (text) and reason.  One pass without a shuffle; all of them, not a sample."""
    found = []
    for name, text in declared.items():
        ct, c = parse_sql_type(text), F.col(name)
        found.append(F.when(c.isNotNull() & _converted(c, ct).isNull(), F.struct(
            F.lit(name).alias("column_name"), F.lit(text).alias("declared_type"), c.cast("string").alias("value"),
            F.lit(f"cannot be read as {ct.kind}").alias("reason"))))
    bad = F.filter(F.array(*found), lambda x: x.isNotNull())
    taken = {"column_name", "declared_type", "value", "reason"} & set(key)
    if taken:
        raise ValueError(f"key columns would clash with the result's: {sorted(taken)}")
    return df.select(*key, F.explode(bad).alias("__bad")).select(*key, "__bad.*")
