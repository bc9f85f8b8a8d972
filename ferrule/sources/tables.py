"""Parquet scans (R01) and table-name guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed value: the longest table name in bytes.
MAX_NAME_BYTES = 63


def validate_relname(name: str) -> str:
    """A table name usable as one path segment: no separators, NUL, '.' or '..', ≤ 63 bytes."""
    one_segment = name not in ("", ".", "..") and not set(name) & set("/\\\0")
    if not one_segment or len(name.encode()) > MAX_NAME_BYTES:
        raise ValueError(f"{name!r} is no table name: one path segment of at most {MAX_NAME_BYTES} bytes")
    return name


def table_path(base: str, name: str, suffix: str = ".parquet") -> str:
    """``base/name+suffix``, refusing names that would leave ``base``."""
    # the validated name is one segment without separators, "." or "..", so it cannot leave
    # ``base``; no normalisation (it would break URIs such as s3a://bucket/dir)
    validate_relname(name)
    return base.rstrip("/") + "/" + name + suffix


def read_table(spark: SparkSession, base: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one table; a column list prunes the Parquet read schema.  The session's initial
    shuffle partition count is raised to fit the table's size (see ``session.size_shuffles``)."""
    from ..session import plan_bytes, size_shuffles
    df = spark.read.parquet(table_path(base, name))
    size_shuffles(spark, plan_bytes(df))
    return df.select(*columns) if columns else df


def read_tables(spark: SparkSession, base: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: read_table(spark, base, n) for n in names}
