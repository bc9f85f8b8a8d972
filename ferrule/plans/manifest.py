"""Load-plan manifests (tables in FK order with row counts and column hints) and the check that
stored data agrees with a manifest's declared types."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spec import DatasetSpec, build_order
from .types import KINDS

MANIFEST_COLUMNS = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("table_order", T.IntegerType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("canonical_kind", T.StringType(), False),
    T.StructField("source_sql", T.StringType(), True),
    T.StructField("precision", T.IntegerType(), True),
    T.StructField("scale", T.IntegerType(), True),
    T.StructField("length", T.IntegerType(), True),
    T.StructField("tz", T.BooleanType(), False),
    T.StructField("nullable", T.BooleanType(), False),
])


def build_manifest(spec: DatasetSpec, namespace: str | None = None) -> dict[str, Any]:
    """Tables in build order with column hints; row counts are filled in by ``with_counts``."""
    tables = []
    for name in build_order(spec):
        t = spec.table(name)
        tables.append({"name": name, "row_count": None, "columns": [
            {"name": c.name, "canonical_kind": c.type.kind, "source_sql": c.type.source,
             "precision": c.type.precision, "scale": c.type.scale, "length": c.type.length,
             "tz": c.type.tz, "nullable": t.is_nullable(c)} for c in t.columns]})
    return {"namespace": namespace, "tables": tables}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) — one count job per table, union of one-row results."""
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_counts(manifest: dict[str, Any], tables: dict[str, DataFrame]) -> dict[str, Any]:
    counts = {r.table_name: r.row_count for r in table_counts(tables).collect()}
    for t in manifest["tables"]:
        t["row_count"] = counts.get(t["name"])
    return manifest


def manifest_frame(spark: SparkSession, manifest: dict[str, Any]) -> DataFrame:
    rows = [(t["name"], ti, ci, c["name"], c["canonical_kind"], c.get("source_sql"), c.get("precision"),
             c.get("scale"), c.get("length"), bool(c.get("tz")), bool(c.get("nullable")))
            for ti, t in enumerate(manifest["tables"]) for ci, c in enumerate(t["columns"])]
    return spark.createDataFrame(rows, MANIFEST_COLUMNS)


# --- type agreement -------------------------------------------------------------------------

_EXACT = {"BOOLEAN": T.BooleanType, "INT16": T.ShortType, "INT32": T.IntegerType,
          "INT64": T.LongType, "FLOAT32": T.FloatType, "FLOAT64": T.DoubleType, "DATE": T.DateType,
          "STRING": T.StringType, "UUID": T.StringType, "JSON": T.StringType, "BYTES": T.BinaryType}


def column_agrees(dtype: T.DataType | None, col: dict[str, Any]) -> str | None:
    """None when ``dtype`` matches the declared column, else the problem text."""
    kind = col["canonical_kind"]
    if kind not in KINDS:
        raise ValueError(f"unknown canonical kind in plan: {kind!r}")
    if dtype is None:
        return "missing"
    if kind in _EXACT:
        return None if isinstance(dtype, _EXACT[kind]) else "type"
    if kind == "DECIMAL":
        if not isinstance(dtype, T.DecimalType):
            return "type"
        p, s = col.get("precision"), col.get("scale")
        if p is not None and dtype.precision != p:
            return "precision"
        if s is not None:
            return None if dtype.scale == s else "scale"
        if p is not None and dtype.scale != 0:
            return "scale"
        return None
    if kind == "TIME":
        return None if isinstance(dtype, T.StringType) or dtype.typeName() == "time" else "type"
    if isinstance(dtype, T.TimestampType):
        return None if col.get("tz") else "tz"
    if isinstance(dtype, T.TimestampNTZType):
        return "tz" if col.get("tz") else None
    return "type"


def _declared_spark_type(col: dict[str, Any]) -> T.DataType | None:
    from .types import CanonicalType
    try:
        return CanonicalType(col["canonical_kind"], precision=col.get("precision"),
                             scale=col.get("scale") if col.get("scale") is not None
                             else (0 if col.get("precision") is not None else None),
                             tz=bool(col.get("tz"))).spark_type()
    except ValueError:
        return None


def type_agreement(table: str, columns: list[dict[str, Any]], df: DataFrame) -> DataFrame:
    """One row per declared column: expected kind, actual Spark type, ok, problem, and
    ``unfit_values`` — stored non-null values the declared type cannot hold (they would fail a
    load into that type).  The counts come from one aggregate pass over the table."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    meta, aggs = [], []
    for i, c in enumerate(columns):
        dtype = fields.get(c["name"])
        problem = column_agrees(dtype, c)
        expected = c["canonical_kind"]
        if expected == "DECIMAL":
            expected += f"({c.get('precision')},{c.get('scale')})"
        target = _declared_spark_type(c)
        if dtype is not None and target is not None:
            v = F.col(c["name"])
            aggs.append(F.count_if(v.isNotNull() & v.try_cast(target).isNull()).alias(f"u{i}"))
        else:
            aggs.append(F.lit(None).cast("long").alias(f"u{i}"))
        meta.append((c["name"], expected, None if dtype is None else dtype.simpleString(),
                     problem is None, problem))
    counts = df.agg(*aggs)
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(n).alias("column_name"),
                 F.lit(e).alias("expected"), F.lit(a).cast("string").alias("actual"),
                 F.lit(ok).alias("ok"), F.lit(p).cast("string").alias("problem"),
                 F.col(f"u{i}").alias("unfit_values"))
        for i, (n, e, a, ok, p) in enumerate(meta)])))
