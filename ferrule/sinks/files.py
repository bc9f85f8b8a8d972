"""File sinks: Parquet, CSV, JSON lines, SQL INSERT statements, COPY text.

Every writer renders lines with Column expressions (no driver rows) and writes a directory of
part files.  With ``order_by`` the rows are range-partitioned and sorted on it, so the part files
concatenated in name order are the table in key order and a re-run writes the same bytes.
"""

from __future__ import annotations

import os
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import render as R
from ..operators.distribution import running_totals
from ..operators.expand import explode_counts, range_start
from ..session import scratch_path, spread
from ..sources.tables import table_path, validate_relname

# Fixed values of the formats.
SQL_BATCH_ROWS = 500
PARQUET_ROW_GROUP_ROWS = 64_000


def _ordered(df: DataFrame, order_by: list[str] | None, parts: int | None) -> DataFrame:
    if not order_by:
        return df
    n = parts or df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)


# --- line builders (lazy DataFrames with one ``line`` column) -------------------------------

def csv_lines(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Header line + one CSV line per row.  ``__k`` orders them (header first)."""
    keys = [F.col(c) for c in (order_by or [])]
    body = spread(df).select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)],
                     R.csv_line(df.schema).alias("line"), F.lit(1).alias("__h"))
    header = df.sparkSession.range(1).select(
        *[F.lit(None).cast(df.schema[c].dataType).alias(f"__k{i}") for i, c in enumerate(order_by or [])],
        F.lit(R.csv_header(df.columns)).alias("line"), F.lit(0).alias("__h"))
    return header.unionByName(body)


def jsonl_lines(df: DataFrame) -> DataFrame:
    return spread(df).select(*df.columns, R.json_line(df.schema).alias("line"))


def copy_lines(df: DataFrame) -> DataFrame:
    return spread(df).select(*df.columns, R.copy_line(df.schema).alias("line"))


def row_numbers(df: DataFrame, order_by: list[str], out: str = "__idx",
                unique_key: bool = False) -> DataFrame:
    """Dense 0-based row numbers in the order of ``order_by`` (any keys: text, NULL, repeated), ties by the
    remaining columns; no single-task window.

    ``unique_key``: ``order_by`` is one unique integral key.  Otherwise rows are first collapsed
    map-side into (row, copies) — a group of identical rows becomes one row, and -0.0 stays apart from
    0.0 — then numbered over ranges of their order, and the copies are exploded back in chunks; no
    key and no group of copies can concentrate in one task."""
    dtype = df.schema[order_by[0]].dataType
    integral = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if unique_key and len(order_by) == 1 and integral:
        return range_start(df, order_by, F.lit(1), out)
    columns = df.columns
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    # grouping makes -0.0 equal to 0.0, so its sign is a column of its own
    below = [((F.col(c) == 0) & F.col(c).cast("string").startswith("-")).alias(f"__below{i}") for i, c in enumerate(floats)]
    signs = [f"__below{i}" for i in range(len(floats))]
    rows = df.select(*columns, *below).groupBy(*columns, *signs).agg(F.count(F.lit(1)).alias("__copies"))
    order = [*order_by, *[c for c in columns if c not in order_by], *signs]
    placed = running_totals(rows, [], order, {"__start": "__copies"}).withColumn("__h", F.xxhash64("__start"))
    exploded = explode_counts(placed, "__start", "__copies", out, "__h")
    exact = {c: F.when(F.col(s), F.lit(-0.0).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c, s in zip(floats, signs)}
    return exploded.select(*[exact.get(c, F.col(c)) for c in columns], out)


def sql_statements(df: DataFrame, table: str, order_by: list[str],
                   batch: int = SQL_BATCH_ROWS, unique_key: bool = False) -> DataFrame:
    """(``stmt_no``, ``statement``): multi-row INSERTs of ``batch`` rows in ``order_by`` order."""
    ident = R.sql_ident(validate_relname(table))
    cols = ", ".join(R.sql_ident(c) for c in df.columns)
    head = f"INSERT INTO {ident} ({cols}) VALUES\n"
    rows = row_numbers(df, order_by, unique_key=unique_key).select(
        F.expr(f"__idx div {batch}").alias("stmt_no"),
        F.struct(F.col("__idx").alias("i"), R.sql_tuple(df.schema).alias("t")).alias("r"))
    grouped = rows.groupBy("stmt_no").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return grouped.select("stmt_no", F.concat(
        F.lit(head), F.array_join(F.transform("rs", lambda r: r["t"]), ",\n"), F.lit(";")
    ).alias("statement"))


# --- writers --------------------------------------------------------------------------------

def _write_text(lines: DataFrame, path: str, order_by: list[str] | None, parts: int | None) -> None:
    _ordered(lines, order_by, parts).select("line").write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, order_by: list[str] | None = None,
                  row_group_rows: int = PARQUET_ROW_GROUP_ROWS, parts: int | None = None,
                  max_records_per_file: int | None = None) -> None:
    """Canonical Parquet directory; row groups sized by rows × an estimated row width."""
    w = _ordered(df, order_by, parts).write.mode("overwrite")
    est_row_bytes = max(8, sum(_width(f.dataType) for f in df.schema.fields))
    w = w.option("parquet.block.size", str(max(1 << 20, row_group_rows * est_row_bytes)))
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(max_records_per_file))
    w.parquet(path)


def _width(dtype: T.DataType) -> int:
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return 32
    if isinstance(dtype, T.DecimalType):
        return 16
    return 8


def write_csv(df: DataFrame, path: str, order_by: list[str] | None = None, parts: int | None = None) -> None:
    keys = [f"__k{i}" for i in range(len(order_by or []))]
    _write_text(csv_lines(df, order_by), path, ["__h", *keys] if order_by else None, parts)


def write_jsonl(df: DataFrame, path: str, order_by: list[str] | None = None, parts: int | None = None) -> None:
    _write_text(jsonl_lines(df), path, order_by, parts)


def write_copy(df: DataFrame, path: str, order_by: list[str] | None = None, parts: int | None = None) -> None:
    _write_text(copy_lines(df), path, order_by, parts)


def write_sql(df: DataFrame, path: str, table: str, order_by: list[str], parts: int | None = None,
              unique_key: bool = False) -> None:
    st = sql_statements(df, table, order_by, unique_key=unique_key)
    _write_text(st.select("stmt_no", F.col("statement").alias("line")), path, ["stmt_no"], parts)


#: What writes a table in each format: (rows, path, table name, keys).
WRITERS = {
    "csv": lambda df, path, name, keys: write_csv(df, path, keys),
    "jsonl": lambda df, path, name, keys: write_jsonl(df, path, keys),
    "sql": lambda df, path, name, keys: write_sql(df, path, name, keys),
    "copy": lambda df, path, name, keys: write_copy(df, path, keys),
}
FORMATS = tuple(WRITERS)


def export_tables(tables: dict[str, DataFrame], out_dir: str, formats: list[str],
                  order_by: dict[str, list[str]]) -> dict[str, Any]:
    """Every table as text in every one of ``formats``, rows in the order of ``order_by`` (default: the first
    column): {out_dir, files: paths by format, total_rows}.  A table that is not a plain scan is stored
    once and read by all its writers; names and formats are checked before anything is written."""
    if not set(formats) <= WRITERS.keys():
        raise ValueError(f"no writer for {', '.join(sorted(set(formats) - WRITERS.keys()))}; there are {', '.join(WRITERS)}")
    targets = {name: {fmt: table_path(out_dir, validate_relname(name), f".{fmt}") for fmt in formats} for name in tables}
    rows = 0
    for name, df in tables.items():
        once = _stored_once(df) if len(formats) > 1 else df
        rows += once.count()
        for fmt, path in targets[name].items():
            WRITERS[fmt](once, path, name, order_by.get(name) or df.columns[:1])
    return {"out_dir": out_dir, "files": {fmt: [paths[fmt] for paths in targets.values()] for fmt in formats}, "total_rows": rows}


def _stored_once(df: DataFrame) -> DataFrame:
    plan = df._jdf.queryExecution().optimizedPlan()
    if not plan.children().nonEmpty() and "Relation" in plan.nodeName():
        return df
    path = scratch_path(df.sparkSession, f"export-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_lines(path: str) -> list[str]:
    """All lines of a written text directory in part-file order (tests and small checks)."""
    out: list[str] = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name), encoding="utf-8") as fh:
                out += fh.read().splitlines()
    return out
