"""Column profiles and rule suggestions.

Suggestion rules, per column of a non-empty table (columns already carrying a rule and
identifier columns — ``id`` or ``*_id`` — are skipped):

- null cap: nulls > 0 → ``max_null_rate = ceil(observed·20)/20`` (two decimals)
- enum: string column with 1 < distinct ≤ 12 and distinct < non-null rows → sorted values
- range: numeric column (not given an enum) with more than one distinct value → min/max as text
  (date/timestamp columns too when ``temporal_ranges`` is set, as the twin does)

Plan: pass A is ONE aggregate over the table (rows, per column null count, min, max, min<max,
HyperLogLog distinct) — partial aggregates on every task, one row back to the driver.  Pass B
runs only for string columns whose HLL estimate is ≤ ``ENUM_SHORTLIST``; it unpivots those
columns into (column, value) pairs and groups them, so each task forwards at most a few dozen
rows per column.  The HLL error at these cardinalities is far below the gap between 12 and 20,
so the shortlist never loses a true candidate and the enum decision itself is exact.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import run_concurrently
from .distribution import exact_profile

# Fixed values of the suggestion rules.
ENUM_MAX_DISTINCT = 12
ENUM_SHORTLIST = 20

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType,
                 T.FloatType, T.DoubleType)

SUGGESTION_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("reason", T.StringType(), False),
    T.StructField("max_null_rate", T.DecimalType(3, 2), True),
    T.StructField("enum_values", T.StringType(), True),
    T.StructField("min_value", T.StringType(), True),
    T.StructField("max_value", T.StringType(), True),
])


def is_identifier(column: str) -> bool:
    return column == "id" or column.endswith("_id")


def _orderable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType,
                                  T.BooleanType))


def column_pass(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """Pass A: one aggregate row with rows and per-column null/min/max/HLL statistics."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, name in enumerate(columns):
        c = F.col(name)
        dtype = df.schema[name].dataType
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        if _orderable(dtype):
            v = F.when(~F.isnan(c), c) if isinstance(dtype, (T.FloatType, T.DoubleType)) else c  # NaN is no bound
            aggs += [F.min(v).cast("string").alias(f"lo{i}"), F.max(v).cast("string").alias(f"hi{i}"),
                     (F.min(v) < F.max(v)).alias(f"spread{i}")]
        else:
            aggs += [F.lit(None).cast("string").alias(f"lo{i}"),
                     F.lit(None).cast("string").alias(f"hi{i}"), F.lit(None).alias(f"spread{i}")]
        aggs.append((F.count_if(F.isnan(c)) if isinstance(dtype, (T.FloatType, T.DoubleType)) else F.lit(0)).alias(f"nan{i}"))
        if isinstance(dtype, T.StringType):
            aggs.append(F.approx_count_distinct(c).alias(f"hll{i}"))
        else:
            aggs.append(F.lit(None).cast("long").alias(f"hll{i}"))
    row = df.agg(*aggs).first().asDict()
    out = {"rows": row["__rows"], "columns": {}}
    for i, name in enumerate(columns):
        out["columns"][name] = {"nulls": row[f"n{i}"], "min": row[f"lo{i}"], "max": row[f"hi{i}"],
                                "spread": row[f"spread{i}"], "hll": row[f"hll{i}"], "nan": row[f"nan{i}"]}
    return out


def _pct(nulls: int, rows: int) -> int:
    """Whole percent, halves rounded up."""
    return int((Decimal(nulls) * 100 / Decimal(rows)).quantize(Decimal(1), rounding=ROUND_HALF_UP))


def suggest_rules(spark: SparkSession, tables: dict[str, DataFrame],
                  existing_rules: list[dict[str, Any]] | None = None,
                  identifiers: set[tuple[str, str]] | None = None,
                  temporal_ranges: bool = False) -> DataFrame:
    """Rule suggestions for a set of tables → DataFrame with ``SUGGESTION_SCHEMA``.

    ``identifiers``: extra (table, column) pairs treated like ``id``/``*_id`` (declared keys).
    ``temporal_ranges``: also suggest observed ranges for date/timestamp columns (ISO text
    bounds; the range test compares them in the column's own type)."""
    ruled = {(r["table"], r["column"]) for r in (existing_rules or [])} | set(identifiers or ())
    small_rows: list[tuple] = []
    enum_parts: list[DataFrame] = []
    todo = {t: [f.name for f in df.schema.fields if (t, f.name) not in ruled and not is_identifier(f.name)]
            for t, df in tables.items()}
    todo = {t: cols for t, cols in todo.items() if cols}
    passes = dict(zip(todo, run_concurrently(  # one aggregate job per table, run side by side
        [lambda t=t: column_pass(tables[t], todo[t]) for t in todo]), strict=True))
    for tname, cols in todo.items():
        df = tables[tname]
        stats = passes[tname]
        rows = stats["rows"]
        if rows == 0:
            continue
        shortlist: list[str] = []
        for name in cols:
            s = stats["columns"][name]
            dtype = df.schema[name].dataType
            nulls = s["nulls"]
            if nulls > 0:
                observed = nulls / rows
                cap = Decimal(repr(round(math.ceil(observed * 20) / 20, 2))).quantize(Decimal("0.01"))
                reason = f"{nulls} of {rows} rows null ({_pct(nulls, rows)}%)"
                small_rows.append((tname, name, "null_rate", reason, cap, None, None, None))
            if nulls == rows:
                continue
            if isinstance(dtype, T.StringType):
                if s["hll"] is not None and s["hll"] <= ENUM_SHORTLIST:
                    shortlist.append(name)
            elif (isinstance(dtype, NUMERIC_TYPES) or (temporal_ranges and isinstance(
                    dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)))) and s["spread"]:
                nan = f", {s['nan']} NaN" if s["nan"] else ""
                small_rows.append((tname, name, "value_range", f"observed {s['min']}..{s['max']}{nan}",
                                   None, None, s["min"], s["max"]))
        if shortlist:
            enum_parts.append(_enum_candidates(df, tname, shortlist, rows,
                                               {n: rows - stats["columns"][n]["nulls"]
                                                for n in shortlist}))
    out = spark.createDataFrame(small_rows, SUGGESTION_SCHEMA)
    for part in enum_parts:
        out = out.unionByName(part)
    return out


def _enum_candidates(df: DataFrame, tname: str, columns: list[str], rows: int,
                     nonnull: dict[str, int]) -> DataFrame:
    """Pass B: exact distinct values of shortlisted string columns → enum suggestions."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("c"), F.col(n).alias("v")) for n in columns])).alias("p"))
    distinct = pairs.select("p.c", "p.v").where(F.col("v").isNotNull()).groupBy("c", "v").count()
    nn = F.create_map(*[x for n in columns for x in (F.lit(n), F.lit(nonnull[n]))])
    per_col = distinct.groupBy("c").agg(
        F.count(F.lit(1)).alias("d"), F.array_sort(F.collect_list("v")).alias("vals"))
    return per_col.where(
        (F.col("d") > 1) & (F.col("d") <= ENUM_MAX_DISTINCT) & (F.col("d") < nn[F.col("c")])
    ).select(
        F.lit(tname).alias("table_name"), F.col("c").alias("column_name"), F.lit("enum").alias("kind"),
        F.format_string(f"only %d distinct values across {rows} rows", F.col("d")).alias("reason"),
        F.lit(None).cast(T.DecimalType(3, 2)).alias("max_null_rate"),
        F.to_json(F.col("vals")).alias("enum_values"),
        F.lit(None).cast("string").alias("min_value"), F.lit(None).cast("string").alias("max_value"))


def profile_columns(df: DataFrame, top_k: int = 10) -> DataFrame:
    """Column distillation, one row per column: type, rows, nulls, exact distinct count, min, max, exact
    quartiles and the ``top_k`` most frequent values (see ``distribution.exact_profile``)."""
    return exact_profile(df, top_k)
