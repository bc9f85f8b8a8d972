"""Profile → rule suggestions (P01–P04) on events (value nulled for errors), orders, part, customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.profile import ENUM_MAX_DISTINCT, is_identifier, suggest_rules

from .common import q, table
from .datatests_wl import _events_nulled

# Column kinds of the driver tables used here (s = string, n = numeric, o = other).
SCHEMAS = {
    "events": [("event_id", "n"), ("ts", "o"), ("user_id", "n"), ("event_type", "s"),
               ("value", "n"), ("props", "s")],
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"),
               ("o_totalprice", "n"), ("o_orderdate", "o"), ("o_orderpriority", "s")],
    "part": [("p_partkey", "n"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"),
             ("p_size", "n"), ("p_retailprice", "n")],
    "customer": [("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "n"),
                 ("c_mktsegment", "s")],
}


def _suggestions(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"events": _events_nulled(spark, sf)}
    for n in ("orders", "part", "customer"):
        tables[n] = table(spark, sf, n)
    return suggest_rules(spark, tables)


def _kind(kind: str | None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _suggestions(spark, sf)
        return df if kind is None else df.where(F.col("kind") == kind)
    return run


def _source(t: str) -> str:
    if t == "events":
        return ("(SELECT event_id, ts, user_id, event_type, "
                "CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, props FROM events)")
    return t


def _sql_column(t: str, c: str, kind: str, want: str) -> str | None:
    src = _source(t)
    head = f"SELECT {q(t)} AS table_name, {q(c)} AS column_name, "
    if want == "null_rate":
        return (head + "'null_rate' AS kind, printf('%d of %d rows null (%d%%)', nulls, rows, "
                "CAST(round(nulls * 100.0 / rows) AS BIGINT)) AS reason, "
                "CAST(ceil(nulls / rows * 20) / 20 AS DECIMAL(3,2)) AS max_null_rate, "
                "CAST(NULL AS VARCHAR) AS enum_values, CAST(NULL AS VARCHAR) AS min_value, "
                "CAST(NULL AS VARCHAR) AS max_value FROM (SELECT count(*) FILTER (WHERE "
                f"{c} IS NULL) AS nulls, count(*) AS rows FROM {src}) WHERE nulls > 0")
    if want == "enum" and kind == "s":
        return (head + "'enum' AS kind, printf('only %d distinct values across %d rows', d, rows) "
                "AS reason, CAST(NULL AS DECIMAL(3,2)) AS max_null_rate, "
                "to_json(vals) AS enum_values, CAST(NULL AS VARCHAR) AS min_value, "
                "CAST(NULL AS VARCHAR) AS max_value FROM (SELECT count(DISTINCT "
                f"{c}) AS d, count({c}) AS nn, count(*) AS rows, list_sort(list(DISTINCT {c})) "
                f"AS vals FROM {src}) WHERE d > 1 AND d <= {ENUM_MAX_DISTINCT} AND d < nn")
    if want == "value_range" and kind == "n":
        return (head + "'value_range' AS kind, 'observed ' || lo || '..' || hi AS reason, "
                "CAST(NULL AS DECIMAL(3,2)) AS max_null_rate, CAST(NULL AS VARCHAR) AS enum_values, "
                "lo AS min_value, hi AS max_value FROM (SELECT CAST(min("
                f"{c}) AS VARCHAR) AS lo, CAST(max({c}) AS VARCHAR) AS hi, min({c}) < max({c}) "
                f"AS spread FROM {src}) WHERE spread")
    return None


def _sql(kinds: list[str]) -> str:
    parts = []
    for t, cols in SCHEMAS.items():
        for c, k in cols:
            if is_identifier(c):
                continue
            for want in kinds:
                s = _sql_column(t, c, k, want)
                if s:
                    parts.append(s)
    return "\nUNION ALL\n".join(parts)


QUERIES = {
    "profile_suggest_null": _kind("null_rate"),
    "profile_suggest_enum": _kind("enum"),
    "profile_suggest_range": _kind("value_range"),
    "profile_suggest_all": _kind(None),
}

ORACLE = {
    "profile_suggest_null": _sql(["null_rate"]),
    "profile_suggest_enum": _sql(["enum"]),
    "profile_suggest_range": _sql(["value_range"]),
    "profile_suggest_all": _sql(["null_rate", "enum", "value_range"]),
}
