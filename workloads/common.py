"""Shared helpers for registered workloads: table loading and oracle SQL text pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.session import apply_defaults
from ferrule.sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_defaults(spark)
    return read_table(spark, sf_dir, name)


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def report_sql(test_id: str, kind: str, table_name: str, column: str | None, category: str,
               passed: str, bad: str, detail: str, source: str) -> str:
    """One report row in DuckDB SQL: ``source`` is a one-row subquery providing the columns
    used by the ``passed``/``bad``/``detail`` expressions."""
    col = "CAST(NULL AS VARCHAR)" if column is None else q(column)
    return (
        f"SELECT {q(test_id)} AS test_id, {q(kind)} AS kind, {q(table_name)} AS table_name, "
        f"{col} AS column_name, {q(category)} AS category, ({passed}) AS passed, "
        f"CAST({bad} AS BIGINT) AS bad_count, "
        f"CASE WHEN NOT ({passed}) THEN {detail} END AS detail FROM ({source}) AS s"
    )
