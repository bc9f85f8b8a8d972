"""Key / FK discovery (R06), typed JSON-lines read-back (R04), declared-schema casts (G29)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.discover import discover_fks, discover_keys
from ferrule.session import scratch_path
from ferrule.sinks.files import write_jsonl
from ferrule.sources.readers import cast_to_schema, read_jsonl

from .common import q, table
from .render_wl import ORDERS_DEC, _decimals

DISCOVER_TABLES = {
    "orders": [("o_orderkey", "i"), ("o_custkey", "i"), ("o_orderstatus", "s"), ("o_totalprice", "o"),
               ("o_orderdate", "o"), ("o_orderpriority", "s")],
    "customer": [("c_custkey", "i"), ("c_name", "s"), ("c_nationkey", "i"), ("c_acctbal", "o"),
                 ("c_mktsegment", "s")],
    "nation": [("n_nationkey", "i"), ("n_name", "s"), ("n_regionkey", "i")],
    "region": [("r_regionkey", "i"), ("r_name", "s")],
    "part": [("p_partkey", "i"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "i"),
             ("p_retailprice", "o")],
    "supplier": [("s_suppkey", "i"), ("s_name", "s"), ("s_nationkey", "i"), ("s_acctbal", "o")],
    "lineitem": [("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"), ("l_quantity", "o"),
                 ("l_extendedprice", "o"), ("l_discount", "o"), ("l_tax", "o"), ("l_returnflag", "s"), ("l_linestatus", "s"),
                 ("l_shipdate", "o")],
}


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in DISCOVER_TABLES}


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    return discover_keys(spark, _tables(spark, sf))


def _fks(spark: SparkSession, sf: str) -> DataFrame:
    return discover_fks(spark, _tables(spark, sf))


def _is_key_sql(t: str, c: str) -> str:
    return f"(SELECT count(*) > 0 AND count({c}) = count(*) AND count(DISTINCT {c}) = count(*) FROM {t})"


KEYS_SQL = " UNION ALL ".join(
    f"SELECT {q(t)} AS table_name, {q(c)} AS column_name, {_is_key_sql(t, c)} AS is_key"
    for t, cols in DISCOVER_TABLES.items() for c, _ in cols)


def _fks_sql() -> str:
    parts = []
    for fam, vt in (("i", "BIGINT"), ("s", "VARCHAR")):
        cols = [(t, c) for t, cs in DISCOVER_TABLES.items() for c, k in cs if k == fam]
        for ct, cc in cols:
            for pt, pc in cols:
                if (ct, cc) == (pt, pc):
                    continue
                parts.append(
                    f"SELECT {q(ct)} AS child_table, {q(cc)} AS child_column, {q(pt)} AS parent_table, "
                    f"{q(pc)} AS parent_column, (SELECT max(n) FROM (SELECT count(*) AS n FROM {ct} "
                    f"WHERE {cc} IS NOT NULL GROUP BY {cc})) AS max_per_parent "
                    f"WHERE (SELECT count({cc}) FROM {ct}) > 0 AND {_is_key_sql(pt, pc)} AND NOT EXISTS "
                    f"(SELECT 1 FROM {ct} WHERE {cc} IS NOT NULL AND CAST({cc} AS {vt}) NOT IN "
                    f"(SELECT CAST({pc} AS {vt}) FROM {pt}))")
    return " UNION ALL ".join(parts)


ORDERS_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "varchar(1)",
                "o_totalprice": "numeric(18,2)", "o_orderdate": "timestamp",
                "o_orderpriority": "text"}


def _jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, f"jsonl-{uuid.uuid4().hex[:12]}")
    write_jsonl(_decimals(table(spark, sf, "orders")), path, ["o_orderkey"])
    return read_jsonl(spark, path, ORDERS_TYPES)


EVENTS_DECLARED = {"event_id": "bigint", "ts": "date", "user_id": "smallint", "event_type": "boolean",
                   "value": "numeric(6,2)", "props": "integer"}


def _cast_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return cast_to_schema(table(spark, sf, "events"), EVENTS_DECLARED)[1]


_DUCK = {"bigint": "BIGINT", "date": "DATE", "smallint": "SMALLINT", "boolean": "BOOLEAN",
         "numeric(6,2)": "DECIMAL(6,2)", "integer": "INTEGER"}
CAST_SQL = " UNION ALL ".join(
    f"SELECT {q(c)} AS column_name, {q(t)} AS declared_type, count(*) FILTER (WHERE {c} IS NOT NULL "
    f"AND TRY_CAST({c} AS {_DUCK[t]}) IS NULL) AS rejected FROM events" for c, t in EVENTS_DECLARED.items())

QUERIES = {
    "discover_keys": _keys,
    "discover_fks": _fks,
    "jsonl_roundtrip": _jsonl_roundtrip,
    "cast_rejects": _cast_rejects,
}
ORACLE = {
    "discover_keys": KEYS_SQL,
    "discover_fks": _fks_sql(),
    "jsonl_roundtrip": f"SELECT * FROM {ORDERS_DEC}",
    "cast_rejects": CAST_SQL,
}
