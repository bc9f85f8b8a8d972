"""Rendering (CSV, JSON lines, SQL INSERT, COPY text) and paging on the driver tables.

Doubles are exported as ``decimal(18,2)`` (the canonical money type); text columns of
``conversations``, ``documents`` and ``events.props`` exercise quoting and escaping over whole
texts; ``events.value`` is nulled for error events to exercise NULL markers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.operators.paging import page
from ferrule.sinks.files import SQL_BATCH_ROWS, copy_lines, csv_lines, jsonl_lines, sql_statements

from .common import q, table
from .datatests_wl import _events_nulled

PAGE_OFFSET, PAGE_LIMIT = 100, 25
DEC = T.DecimalType(18, 2)


def _decimals(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(DEC).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def _render_csv(spark: SparkSession, sf: str) -> DataFrame:
    return csv_lines(table(spark, sf, "conversations"), ["conv_id", "turn"]).select("line")


def _render_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl_lines(_decimals(table(spark, sf, "orders"))).select("line")


def _render_sql(spark: SparkSession, sf: str) -> DataFrame:
    return sql_statements(_decimals(table(spark, sf, "customer")), "customer", ["c_custkey"],
                          unique_key=True)


def _render_copy(spark: SparkSession, sf: str) -> DataFrame:
    return copy_lines(_decimals(_events_nulled(spark, sf))).select("line")


def _render_copy_documents(spark: SparkSession, sf: str) -> DataFrame:
    return copy_lines(table(spark, sf, "documents")).select("line")


def _page_rows(spark: SparkSession, sf: str) -> DataFrame:
    return page(table(spark, sf, "orders"), ["o_orderkey"], PAGE_OFFSET, PAGE_LIMIT,
                json_safe_values=True)


# --- oracle SQL -----------------------------------------------------------------------------

NL, TAB = "chr(10)", "chr(9)"


def _frac(x: str) -> str:
    return (f"CASE WHEN microsecond({x}) % 1000000 <> 0 THEN '.' || "
            f"lpad(CAST(microsecond({x}) % 1000000 AS VARCHAR), 6, '0') ELSE '' END")


def _ts(x: str, sep: str) -> str:
    return f"(strftime({x}, '%Y-%m-%d{sep}%H:%M:%S') || {_frac(x)})"


def _nn(x: str, v: str, null: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN {null} ELSE {v} END"


def _csv(x: str, kind: str) -> str:
    if kind == "n":
        v = f"CAST({x} AS VARCHAR)"
    else:
        v = f"'\"' || replace(CAST({x} AS VARCHAR), '\"', '\"\"') || '\"'"
    return _nn(x, v, "''")


def _json(x: str, kind: str) -> str:
    v = {"n": f"CAST({x} AS VARCHAR)", "d": f"'\"' || CAST({x} AS VARCHAR) || '\"'",
         "s": f"to_json({x})", "t": f"'\"' || {_ts(x, 'T')} || '\"'"}[kind]
    return _nn(x, v, "'null'")


def _sqllit(x: str, kind: str) -> str:
    v = {"n": f"CAST({x} AS VARCHAR)", "d": f"CAST({x} AS VARCHAR)",
         "s": f"'''' || replace({x}, '''', '''''') || ''''"}[kind]
    return _nn(x, v, "'NULL'")


def _esc(v: str) -> str:
    return (f"replace(replace(replace(replace({v}, '\\', '\\\\'), {TAB}, '\\t'), {NL}, '\\n'), "
            f"chr(13), '\\r')")


def _copy(x: str, kind: str) -> str:
    v = {"n": f"CAST({x} AS VARCHAR)", "d": f"CAST({x} AS VARCHAR)", "s": _esc(x),
         "t": _ts(x, " ")}[kind]
    return _nn(x, v, "'\\N'")


CONV = [("conv_id", "n"), ("turn", "n"), ("role", "s"), ("text", "s")]
ORDERS = [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "d"),
          ("o_orderdate", "t"), ("o_orderpriority", "s")]
CUST = [("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "d"),
        ("c_mktsegment", "s")]
EVENTS = [("event_id", "n"), ("ts", "t"), ("user_id", "n"), ("event_type", "s"), ("value", "d"),
          ("props", "s")]
DOCS = [("doc_id", "n"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "n")]

ORDERS_DEC = ("(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) "
              "AS o_totalprice, o_orderdate, o_orderpriority FROM orders)")
CUST_DEC = ("(SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, "
            "c_mktsegment FROM customer)")
EVENTS_DEC = ("(SELECT event_id, ts, user_id, event_type, CAST(CASE WHEN event_type = 'error' THEN "
              "NULL ELSE value END AS DECIMAL(18,2)) AS value, props FROM events)")

CSV_SQL = (f"SELECT {q(','.join(chr(34) + c + chr(34) for c, _ in CONV))} AS line UNION ALL "
           f"SELECT concat_ws(',', {', '.join(_csv(c, k) for c, k in CONV)}) AS line FROM conversations")

_json_parts = " || ', ' || ".join(f"'\"{c}\": ' || {_json(c, k)}" for c, k in ORDERS)
JSONL_SQL = f"SELECT '{{' || {_json_parts} || '}}' AS line FROM {ORDERS_DEC}"

_ins_head = ("INSERT INTO \"customer\" (" + ", ".join(f'"{c}"' for c, _ in CUST) + ") VALUES")
SQL_SQL = (
    f"WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, "
    f"'  (' || concat_ws(', ', {', '.join(_sqllit(c, k) for c, k in CUST)}) || ')' AS t FROM {CUST_DEC}) "
    f"SELECT CAST(idx // {SQL_BATCH_ROWS} AS BIGINT) AS stmt_no, {q(_ins_head)} || {NL} || "
    f"string_agg(t, ',' || {NL} ORDER BY idx) || ';' AS statement FROM r GROUP BY idx // {SQL_BATCH_ROWS}")

COPY_SQL = f"SELECT concat_ws({TAB}, {', '.join(_copy(c, k) for c, k in EVENTS)}) AS line FROM {EVENTS_DEC}"
COPY_DOCS_SQL = f"SELECT concat_ws({TAB}, {', '.join(_copy(c, k) for c, k in DOCS)}) AS line FROM documents"

PAGE_SQL = (f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_ts('o_orderdate', 'T')} "
            f"AS o_orderdate, o_orderpriority, (SELECT count(*) FROM orders) AS total_rows FROM orders "
            f"ORDER BY o_orderkey LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET}")

QUERIES = {
    "render_csv": _render_csv,
    "render_jsonl": _render_jsonl,
    "render_sql": _render_sql,
    "render_copy": _render_copy,
    "render_copy_documents": _render_copy_documents,
    "page_rows": _page_rows,
}
ORACLE = {
    "render_csv": CSV_SQL,
    "render_jsonl": JSONL_SQL,
    "render_sql": SQL_SQL,
    "render_copy": COPY_SQL,
    "render_copy_documents": COPY_DOCS_SQL,
    "page_rows": PAGE_SQL,
}
