"""Synthetic twin of customer + orders (G28 → G20 → V07/V08) and the sample judge (V09).

The report is data-test rows over the generated twin; every row is expected to pass.  Its tests
depend on profiled rules, so there is no SQL oracle (rows-only check).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.twin import judge_sample, make_twin
from ferrule.session import scratch_path

from .common import table
from .render_wl import _decimals

PRIMARY_KEYS = {"customer": ["c_custkey"], "orders": ["o_orderkey"]}
FOREIGN_KEYS = {"orders": [{"column": "o_custkey", "references_table": "customer",
                            "references_column": "c_custkey"}]}


def twin_of_source(spark: SparkSession, sf: str, materialize: bool = True):
    cust = _decimals(table(spark, sf, "customer"))
    orders = _decimals(table(spark, sf, "orders")).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("date"))
    path = scratch_path(spark, f"twin-{uuid.uuid4().hex[:12]}") if materialize else None
    return make_twin(spark, {"customer": cust, "orders": orders}, PRIMARY_KEYS, FOREIGN_KEYS, seed=42,
                     materialize_dir=path)


def _twin_report(spark: SparkSession, sf: str) -> DataFrame:
    return twin_of_source(spark, sf).report()


def _twin_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = twin_of_source(spark, sf)
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for n, df in t.data.items()]
    return parts[0].unionByName(parts[1])


def _judge(spark: SparkSession, sf: str) -> DataFrame:
    t = twin_of_source(spark, sf, materialize=False)
    return judge_sample(spark, t.spec_json, t.rules, sample_rows=200,
                        materialize_dir=scratch_path(spark, f"judge-{uuid.uuid4().hex[:12]}"))


QUERIES = {
    "twin_report": _twin_report,
    "twin_counts": _twin_counts,
    "judge_sample": _judge,
}
def _twin_counts_sql() -> str:
    """Twin customers = source customers; twin orders = Σ k over customer positions, k drawn in
    [min, max] orders per customer observed on the source (customers without orders count 0)."""
    from ferrule.functions.draw import derive_seed

    from .gen_sql import draws_sql
    seed = derive_seed(42, "orders", "__cardinality__", "o_custkey")
    per = ("SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer AS c LEFT JOIN orders AS o "
           "ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
    bounds = f"SELECT min(n) AS lo, max(n) AS hi FROM ({per})"
    d = draws_sql("SELECT range AS __prow FROM range((SELECT count(*) FROM customer))", "__prow",
                  {"__k0": seed})
    return ("SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL "
            f"SELECT 'orders', CAST(sum(b.lo + d.__k0 % (b.hi - b.lo + 1)) AS BIGINT) FROM ({d}) AS d, "
            f"({bounds}) AS b")


# Columns of the twin's sources by kind (keys excluded: they are identifiers).
TWIN_STRING = {"customer": ["c_name", "c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"]}
TWIN_NUMERIC = {"customer": ["c_nationkey", "c_acctbal"], "orders": ["o_totalprice", "o_orderdate"]}


def _twin_report_sql() -> str:
    """The tests a twin derives (enum / range rules profiled from the source, keys, FKs), each
    expected to pass with no bad rows: the twin's contract."""
    from ferrule.operators.profile import ENUM_MAX_DISTINCT

    from .common import q

    def row(test_id, kind, t, c, cat, cond="TRUE"):
        return (f"SELECT {q(test_id)} AS test_id, {q(kind)} AS kind, {q(t)} AS table_name, {q(c)} AS "
                f"column_name, {q(cat)} AS category, TRUE AS passed, CAST(0 AS BIGINT) AS bad_count, "
                f"CAST(NULL AS VARCHAR) AS detail WHERE {cond}")
    parts = []
    for t, cols in TWIN_STRING.items():
        for c in cols:
            parts.append(row(f"enum:{t}.{c}", "enum", t, c, "constraint",
                             f"(SELECT count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) <= {ENUM_MAX_DISTINCT} "
                             f"AND count(DISTINCT {c}) < count({c}) FROM {t})"))
    for t, cols in TWIN_NUMERIC.items():
        for c in cols:
            parts.append(row(f"value_range:{t}.{c}", "value_range", t, c, "constraint",
                             f"(SELECT min({c}) < max({c}) FROM {t})"))
    parts += [row("unique:customer.c_custkey", "unique", "customer", "c_custkey", "uniqueness"),
              row("unique:orders.o_orderkey", "unique", "orders", "o_orderkey", "uniqueness"),
              row("fk_resolves:orders.o_custkey", "fk_resolves", "orders", "o_custkey", "referential"),
              row("fk_cardinality:orders.o_custkey", "fk_cardinality", "orders", "o_custkey", "referential")]
    return " UNION ALL ".join(parts)


# the judge runs the same derived tests on a 200-row sample of the same spec: same contract
ORACLE: dict[str, str] = {"twin_counts": _twin_counts_sql(), "twin_report": _twin_report_sql(),
                          "judge_sample": _twin_report_sql()}
