"""Data tests (V01–V08) on the driver tables.

Nulls and orphans do not occur in the driver tables, so the inputs provoke them: ``value`` is
nulled for ``error`` events, the FK parent is restricted to finished orders, and rules are tight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.datatests import ENUM_EXTRAS_SHOWN, DataTest, run_tests

from .common import q, report_sql, table

# Fixed values of the workloads (rules and caps of the checks).
DISCOUNT_MIN, DISCOUNT_MAX = "0.02", "0.08"
ALLOWED_PRIORITIES = ["1-URGENT", "2-HIGH"]
NULL_CAPS = [0, 0.1, 0.5]
MAX_ORDERS_PER_CUSTOMER = 15


def _events_nulled(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.withColumn("value", F.when(F.col("event_type") == "error", None)
                         .otherwise(F.col("value")))


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    orders = table(spark, sf, "orders")
    return {
        "lineitem": table(spark, sf, "lineitem"),
        "orders": orders,
        "orders_f": orders.where(F.col("o_orderstatus") == "F"),
        "events": _events_nulled(spark, sf),
    }


T_VALUE_RANGE = [DataTest("value_range", "lineitem", "l_discount",
                          {"min": DISCOUNT_MIN, "max": DISCOUNT_MAX})]
T_ENUM = [DataTest("enum", "orders", "o_orderpriority", {"values": ALLOWED_PRIORITIES})]
T_NULL = [DataTest("null_rate", "events", "value", {"max": cap}) for cap in NULL_CAPS]
T_UNIQUE = [DataTest("unique", "orders", "o_orderkey"), DataTest("unique", "lineitem", "l_orderkey")]
T_FK = [DataTest("fk_resolves", "lineitem", "l_orderkey",
                 {"ref_table": "orders_f", "ref_column": "o_orderkey"})]
T_CARD = [DataTest("fk_cardinality", "orders", "o_custkey",
                   {"max_per_parent": MAX_ORDERS_PER_CUSTOMER})]
T_SUITE = T_VALUE_RANGE + T_ENUM + T_NULL + T_UNIQUE + T_FK + T_CARD


def _runner(tests: list[DataTest]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return run_tests(_tables(spark, sf), tests)
    return run


# --- oracle SQL -----------------------------------------------------------------------------

def _sql_value_range(t: DataTest) -> str:
    c = t.column
    bad = (f"{c} IS NOT NULL AND (isnan({c}) OR {c} < CAST({t.params['min']} AS DOUBLE) "
           f"OR {c} > CAST({t.params['max']} AS DOUBLE))")
    src = (f"SELECT count(*) FILTER (WHERE {bad}) AS n, min({c}) FILTER (WHERE {bad}) AS ex "
           f"FROM {t.table}")
    detail = (f"printf('%d values outside [{t.params['min']}, {t.params['max']}], e.g. %s', "
              f"n, CAST(ex AS VARCHAR))")
    return report_sql(t.test_id, t.kind, t.table, c, "constraint", "n = 0", "n", detail, src)


def _sql_enum(t: DataTest) -> str:
    c = t.column
    allowed = ", ".join(q(v) for v in t.params["values"])
    k = ENUM_EXTRAS_SHOWN
    src = (
        f"WITH x AS (SELECT {c} AS v, count(*) AS n FROM {t.table} "
        f"WHERE {c} IS NOT NULL AND {c} NOT IN ({allowed}) GROUP BY 1) "
        f"SELECT coalesce(sum(n), 0) AS bad, count(*) AS d, "
        f"(SELECT string_agg('''' || v || '''', ', ' ORDER BY v) FROM "
        f"(SELECT v FROM x ORDER BY v LIMIT {k})) AS ex FROM x")
    detail = ("'values outside the allowed set: [' || coalesce(ex, '') || "
              f"CASE WHEN d > {k} THEN printf(', ... (%d distinct)', d) ELSE '' END || ']'")
    return report_sql(t.test_id, t.kind, t.table, c, "constraint", "bad = 0", "bad", detail, src)


def _sql_null_rate(t: DataTest, source_table: str) -> str:
    c = t.column
    cap = float(t.params["max"])
    slack = 0.0 if cap == 0.0 else 0.05
    src = f"SELECT count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows FROM {source_table}"
    passed = f"rows = 0 OR nulls / rows <= {cap + slack!r}"
    detail = f"printf('observed null rate %.2f exceeds declared max {cap:.2f}', nulls / rows)"
    return report_sql(t.test_id, t.kind, t.table, c, "null_rate", passed, "nulls", detail, src)


def _sql_unique(t: DataTest) -> str:
    c = t.column
    src = (f"WITH k AS (SELECT {c}, count(*) AS n FROM {t.table} WHERE {c} IS NOT NULL GROUP BY 1) "
           f"SELECT count(*) FILTER (WHERE n > 1) AS keys, "
           f"coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS surplus FROM k")
    detail = ("printf('duplicate values in a unique column: %d values repeated, %d surplus rows', "
              "keys, surplus)")
    return report_sql(t.test_id, t.kind, t.table, c, "uniqueness", "keys = 0", "surplus", detail, src)


def _sql_fk_resolves(t: DataTest, parent_sql: str) -> str:
    c = t.column
    ref = t.params["ref_column"]
    src = (f"SELECT count(*) AS bad FROM {t.table} AS ch WHERE ch.{c} IS NOT NULL AND NOT EXISTS "
           f"(SELECT 1 FROM ({parent_sql}) AS p WHERE p.{ref} = ch.{c})")
    detail = "printf('%d FK values do not resolve to a parent key', bad)"
    return report_sql(t.test_id, t.kind, t.table, c, "referential", "bad = 0", "bad", detail, src)


def _sql_fk_cardinality(t: DataTest) -> str:
    c = t.column
    cap = int(t.params["max_per_parent"])
    src = (f"SELECT count(*) AS over FROM (SELECT {c}, count(*) AS n FROM {t.table} "
           f"WHERE {c} IS NOT NULL GROUP BY 1) WHERE n > {cap}")
    detail = f"printf('%d parents exceed max_per_parent {cap}', over)"
    return report_sql(t.test_id, t.kind, t.table, c, "referential", "over = 0", "over", detail, src)


EVENTS_NULLED_SQL = ("(SELECT CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value "
                     "FROM events)")
ORDERS_F_SQL = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"


def _sql(tests: list[DataTest]) -> str:
    parts = []
    for t in tests:
        if t.kind == "value_range":
            parts.append(_sql_value_range(t))
        elif t.kind == "enum":
            parts.append(_sql_enum(t))
        elif t.kind == "null_rate":
            parts.append(_sql_null_rate(t, EVENTS_NULLED_SQL))
        elif t.kind == "unique":
            parts.append(_sql_unique(t))
        elif t.kind == "fk_resolves":
            parts.append(_sql_fk_resolves(t, ORDERS_F_SQL))
        elif t.kind == "fk_cardinality":
            parts.append(_sql_fk_cardinality(t))
    return "\nUNION ALL\n".join(parts)


QUERIES = {
    "dt_value_range": _runner(T_VALUE_RANGE),
    "dt_enum": _runner(T_ENUM),
    "dt_null_rate": _runner(T_NULL),
    "dt_unique": _runner(T_UNIQUE),
    "dt_fk_resolves": _runner(T_FK),
    "dt_fk_cardinality": _runner(T_CARD),
    "dt_suite": _runner(T_SUITE),
}

ORACLE = {
    "dt_value_range": _sql(T_VALUE_RANGE),
    "dt_enum": _sql(T_ENUM),
    "dt_null_rate": _sql(T_NULL),
    "dt_unique": _sql(T_UNIQUE),
    "dt_fk_resolves": _sql(T_FK),
    "dt_fk_cardinality": _sql(T_CARD),
    "dt_suite": _sql(T_SUITE),
}
