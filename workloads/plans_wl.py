"""Manifests (S06), type agreement (S07), Parquet write + verified read-back (S01, S09)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.compare import table_digest
from ferrule.plans.manifest import build_manifest, manifest_frame, table_counts, type_agreement
from ferrule.session import scratch_path
from ferrule.sinks.files import write_parquet

from .common import q, table
from .generation_wl import DATASET, _dataset_counts_sql, build_dataset

# Declared columns of the stored customer table; c_acctbal is declared as money (the file holds
# a double) and c_phone is declared but absent.
CUSTOMER_DECLARED = [
    {"name": "c_custkey", "canonical_kind": "INT64"},
    {"name": "c_name", "canonical_kind": "STRING"},
    {"name": "c_nationkey", "canonical_kind": "INT32"},
    {"name": "c_acctbal", "canonical_kind": "DECIMAL", "precision": 12, "scale": 2},
    {"name": "c_mktsegment", "canonical_kind": "STRING"},
    {"name": "c_phone", "canonical_kind": "STRING"},
]


def _manifest_columns(spark: SparkSession, sf: str) -> DataFrame:
    data = build_dataset(spark, sf)
    cols = manifest_frame(spark, build_manifest(DATASET))
    return cols.join(table_counts(data), "table_name")


def _manifest_sql() -> str:
    man = build_manifest(DATASET)
    rows = []
    for ti, t in enumerate(man["tables"]):
        for ci, c in enumerate(t["columns"]):
            def v(x):
                return "NULL" if x is None else (q(x) if isinstance(x, str) else str(x).upper()
                                                 if isinstance(x, bool) else str(x))
            rows.append(f"({q(t['name'])}, {ti}, {ci}, {q(c['name'])}, {q(c['canonical_kind'])}, "
                        f"{v(c['source_sql'])}, {v(c['precision'])}, {v(c['scale'])}, {v(c['length'])}, "
                        f"{v(c['tz'])}, {v(c['nullable'])})")
    values = ", ".join(rows)
    return ("SELECT m.table_name, CAST(table_order AS INTEGER) AS table_order, CAST(position AS INTEGER) AS position, "
            "column_name, canonical_kind, source_sql, CAST(precision AS INTEGER) AS precision, "
            "CAST(scale AS INTEGER) AS scale, CAST(length AS INTEGER) AS length, tz, nullable, c.row_count "
            f"FROM (VALUES {values}) AS m(table_name, table_order, position, column_name, canonical_kind, "
            "source_sql, precision, scale, length, tz, nullable) "
            f"JOIN ({_dataset_counts_sql()}) AS c ON c.table_name = m.table_name")


def _type_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return type_agreement("customer", CUSTOMER_DECLARED, table(spark, sf, "customer"))


def _type_agreement_sql() -> str:
    decl = ", ".join(
        f"({q(c['name'])}, {q(c['canonical_kind'] + (f'({c['precision']},{c['scale']})' if c['canonical_kind'] == 'DECIMAL' else ''))}, "
        f"{q(c['canonical_kind'])})" for c in CUSTOMER_DECLARED)
    actual = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' "
              "THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE lower(data_type) END")
    kind_ok = ("CASE d.kind WHEN 'INT64' THEN a.actual = 'bigint' WHEN 'INT32' THEN a.actual = 'int' "
               "WHEN 'STRING' THEN a.actual = 'string' WHEN 'FLOAT64' THEN a.actual = 'double' "
               "WHEN 'DECIMAL' THEN a.actual LIKE 'decimal%' ELSE FALSE END")
    duck = {"INT64": "BIGINT", "INT32": "INTEGER", "STRING": "VARCHAR"}
    unfit = " UNION ALL ".join(
        f"SELECT {q(c['name'])} AS column_name, count(*) FILTER (WHERE {c['name']} IS NOT NULL AND "
        f"TRY_CAST({c['name']} AS "
        f"{duck.get(c['canonical_kind']) or 'DECIMAL(%d,%d)' % (c['precision'], c['scale'])}) IS NULL) AS n "
        "FROM customer" for c in CUSTOMER_DECLARED if c["name"] != "c_phone")
    return ("SELECT 'customer' AS table_name, d.column_name, d.expected, a.actual, "
            f"coalesce({kind_ok}, FALSE) AS ok, "
            f"CASE WHEN a.actual IS NULL THEN 'missing' WHEN NOT ({kind_ok}) THEN 'type' END AS problem, "
            "u.n AS unfit_values "
            f"FROM (VALUES {decl}) AS d(column_name, expected, kind) LEFT JOIN "
            f"(SELECT column_name, {actual} AS actual FROM information_schema.columns "
            "WHERE table_name = 'customer') AS a ON a.column_name = d.column_name "
            f"LEFT JOIN ({unfit}) AS u ON u.column_name = d.column_name")


def _parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    data = build_dataset(spark, sf)
    base = scratch_path(spark, f"roundtrip-{uuid.uuid4().hex[:12]}")
    order = {"wells": ["id"], "readings": ["id"]}
    for name, df in data.items():
        write_parquet(df, f"{base}/{name}", order_by=order[name])
    parts = []
    for name, df in data.items():
        back = spark.read.parquet(f"{base}/{name}")
        u = (table_digest(df, name).withColumn("side", F.lit(1))
             .unionByName(table_digest(back, name).withColumn("side", F.lit(2))))

        def side(col: str, k: int):
            return F.max(F.when(F.col("side") == k, F.col(col)))
        parts.append(u.groupBy("table_name").agg(
            side("row_count", 1).alias("expected"), side("row_count", 2).alias("actual"),
            (side("row_count", 1) == side("row_count", 2)).alias("ok"),
            ((side("xor_hash", 1) == side("xor_hash", 2))
             & (side("sum_hash", 1) == side("sum_hash", 2))).alias("digest_equal")))
    return parts[0].unionByName(parts[1])


def _roundtrip_sql() -> str:
    return (f"SELECT table_name, row_count AS expected, row_count AS actual, TRUE AS ok, "
            f"TRUE AS digest_equal FROM ({_dataset_counts_sql()})")


QUERIES = {
    "manifest_columns": _manifest_columns,
    "type_agreement": _type_agreement,
    "verify_counts": _parquet_roundtrip,
}
ORACLE = {
    "manifest_columns": _manifest_sql(),
    "type_agreement": _type_agreement_sql(),
    "verify_counts": _roundtrip_sql(),
}
