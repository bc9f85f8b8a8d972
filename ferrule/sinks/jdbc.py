"""Loads into JDBC databases with per-dialect column types and value binding.

The target table is created with dialect DDL over one driver-side JDBC connection (Spark's
``createTableColumnTypes`` accepts only Spark type names, so types such as ``JSONB`` or
``TIMESTAMP WITH TIME ZONE`` need explicit DDL); the rows are then appended by ``write.jdbc`` from
every task in batches.  Values are bound per dialect inside the plan: booleans become 1/0 where
the dialect has no BOOLEAN column, zoned timestamps become UTC wall time where it has no zoned
timestamp type.  Spark commits per task, so callers verify counts afterwards (``count_rows``).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import sql_ident

DIALECTS = ("postgresql", "h2", "db2", "ansi")
# Fixed value: longest VARCHAR of the DB2 / ANSI dialects before CLOB.
VARCHAR_MAX_DB2 = 32_672


def dialect_of(url: str) -> str:
    u = url.lower()
    if u.startswith("jdbc:postgresql"):
        return "postgresql"
    if u.startswith("jdbc:h2"):
        return "h2"
    if u.startswith("jdbc:db2"):
        return "db2"
    return "ansi"


def _no_boolean(d: str) -> bool:
    return d in ("db2", "ansi")


def _no_zoned_timestamp(d: str) -> bool:
    return d in ("db2", "ansi")


def column_type(dialect: str, col: dict[str, Any]) -> str:
    """DDL type of a manifest column (canonical kind + hints) in ``dialect``."""
    k = col["canonical_kind"]
    p, s, n = col.get("precision"), col.get("scale"), col.get("length")
    if k == "BOOLEAN":
        return "SMALLINT" if _no_boolean(dialect) else "BOOLEAN"
    simple = {"INT16": "SMALLINT", "INT32": "INTEGER", "INT64": "BIGINT", "FLOAT32": "REAL",
              "DATE": "DATE", "TIME": "TIME"}
    if k in simple:
        return simple[k]
    if k == "FLOAT64":
        return "DOUBLE" if dialect == "db2" else "DOUBLE PRECISION"
    if k == "TIMESTAMP":
        return "TIMESTAMP WITH TIME ZONE" if col.get("tz") and not _no_zoned_timestamp(dialect) \
            else "TIMESTAMP"
    if k == "UUID":
        return "UUID" if dialect in ("postgresql", "h2") else "CHAR(36)"
    if k == "JSON":
        return "JSONB" if dialect == "postgresql" else "CLOB"
    if k == "BYTES":
        return {"postgresql": "BYTEA", "h2": "VARBINARY(1000000)"}.get(dialect, "BLOB")
    if k == "DECIMAL":
        if p is None:
            return "NUMERIC"
        return f"NUMERIC({p})" if s is None else f"NUMERIC({p},{s})"
    if k == "STRING":
        if n is not None:
            return "CLOB" if dialect in ("db2", "ansi") and int(n) > VARCHAR_MAX_DB2 else f"VARCHAR({int(n)})"
        return "TEXT" if dialect == "postgresql" else "CLOB"
    raise ValueError(f"unknown canonical kind: {k!r}")


def create_table_ddl(dialect: str, table: str, columns: list[dict[str, Any]]) -> str:
    cols = ", ".join(f"{sql_ident(c['name'])} {column_type(dialect, c)}"
                     + ("" if c.get("nullable", True) else " NOT NULL") for c in columns)
    return f"CREATE TABLE {sql_ident(table)} ({cols})"


def bind(df: DataFrame, dialect: str, columns: list[dict[str, Any]]) -> DataFrame:
    """Cast values to what the dialect stores (booleans 1/0, zoned timestamps as UTC wall time)."""
    kinds = {c["name"]: c for c in columns}
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        k = kinds.get(f.name, {})
        if k.get("canonical_kind") == "BOOLEAN" and _no_boolean(dialect):
            c = F.when(c, F.lit(1)).when(~c, F.lit(0)).cast("short")
        elif k.get("canonical_kind") == "TIMESTAMP" and k.get("tz") and _no_zoned_timestamp(dialect):
            c = c.cast("timestamp_ntz")  # UTC session: the wall time in UTC
        out.append(c.alias(f.name))
    return df.select(*out)


def _execute(spark: SparkSession, url: str, statement: str, props: dict[str, str]) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.java.util.Properties()
    for k, v in props.items():
        p.setProperty(k, v)
    conn = jvm.java.sql.DriverManager.getConnection(url, p)
    try:
        st = conn.createStatement()
        st.execute(statement)
        st.close()
    finally:
        conn.close()


def load_jdbc(spark: SparkSession, df: DataFrame, url: str, table: str,
              columns: list[dict[str, Any]], properties: dict[str, str] | None = None,
              batch_rows: int = 500, create: bool = True) -> None:
    """Create ``table`` with dialect types (``create``) and append ``df`` in batches."""
    props = dict(properties or {})
    dialect = dialect_of(url)
    if create:
        _execute(spark, url, create_table_ddl(dialect, table, columns), props)
    (bind(df, dialect, columns).write.mode("append").option("batchsize", str(batch_rows))
     .jdbc(url, sql_ident(table), properties=props))


def count_rows(spark: SparkSession, url: str, table: str,
               properties: dict[str, str] | None = None) -> int:
    return spark.read.jdbc(url, f"(SELECT COUNT(*) AS n FROM {sql_ident(table)}) t",
                           properties=dict(properties or {})).first()[0]
