"""Second-tier operators on the driver tables: cross-table and structural rules, consistent
subsets, diffs, schema drift, distribution fidelity, coverage, PII scan, leakage, row edits,
empirical resampling, self-referencing keys, report scores and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.draw import derive_seed, unit_cut
from ferrule.operators.compare import (boundary_coverage, category_fidelity, dataset_diff,
                                       numeric_fidelity, pair_coverage, schema_drift,
                                       value_coverage, verbatim_leakage)
from ferrule.operators.datatests import SEVERITY, DataTest, run_tests, score_report
from ferrule.operators.edits import apply_edits
from ferrule.operators.empirical import empirical_column
from ferrule.operators.generate import ROW, generate_dataset
from ferrule.operators.pii import PII_PATTERNS, pii_scan
from ferrule.operators.subset import consistent_subset
from ferrule.plans.spec import parse_spec

from . import gen_sql as G
from .common import q, report_sql, table
from .datatests_wl import T_SUITE
from .datatests_wl import _sql as suite_sql
from .datatests_wl import _tables as suite_tables
from .generation_wl import table_sql

SEED = 42

# --- cross-field and structural rules (X04, X05) ---------------------------------------------

RULE_TESTS = [
    DataTest("cross_field", "lineitem", "l_shipdate",
             {"ref_table": "orders", "on": [["l_orderkey", "o_orderkey"]],
              "expr": "l_shipdate >= o_orderdate", "parent_columns": ["o_orderdate"]}),
    DataTest("row_rule", "orders", None, {"expr": "o_orderstatus <> 'F' OR o_totalprice > 1000"}),
    DataTest("regex", "customer", "c_name", {"pattern": "^Customer#[0-9]{9}$"}),
    DataTest("length", "part", "p_name", {"min": 10, "max": 40}),
]


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer", "part")}
    return run_tests(t, RULE_TESTS)


def _rules_sql() -> str:
    a, b, c, d = RULE_TESTS
    parts = [
        report_sql(a.test_id, a.kind, a.table, a.column, "cross_table", "bad = 0", "bad",
                   f"printf('%d rows violate {a.params['expr']}', bad)",
                   "SELECT count(*) FILTER (WHERE NOT coalesce(l_shipdate >= o_orderdate, TRUE)) AS bad "
                   "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
        report_sql(b.test_id, b.kind, b.table, None, "constraint", "n = 0", "n",
                   f"printf('%d rows violate {b.params['expr'].replace(chr(39), chr(39) * 2)}', n)",
                   f"SELECT count(*) FILTER (WHERE NOT coalesce({b.params['expr']}, TRUE)) AS n FROM orders"),
        report_sql(c.test_id, c.kind, c.table, c.column, "structure", "n = 0", "n",
                   "printf('%d values do not match the pattern, e.g. %s', n, ex)",
                   f"SELECT count(*) FILTER (WHERE c_name IS NOT NULL AND NOT regexp_matches(c_name, "
                   f"{q(c.params['pattern'])})) AS n, min(c_name) FILTER (WHERE c_name IS NOT NULL AND NOT "
                   f"regexp_matches(c_name, {q(c.params['pattern'])})) AS ex FROM customer"),
        report_sql(d.test_id, d.kind, d.table, d.column, "structure", "n = 0", "n",
                   "printf('%d values with length outside [10, 40], e.g. length %s', n, CAST(ex AS VARCHAR))",
                   "SELECT count(*) FILTER (WHERE p_name IS NOT NULL AND (length(p_name) < 10 OR "
                   "length(p_name) > 40)) AS n, min(length(p_name)) FILTER (WHERE p_name IS NOT NULL AND "
                   "(length(p_name) < 10 OR length(p_name) > 40)) AS ex FROM part"),
    ]
    return " UNION ALL ".join(parts)


# --- consistent subset (X01) -----------------------------------------------------------------

SUBSET_FRACTION = 0.1
DOWN = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
UP = [("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
      ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
      ("nation", "n_regionkey", "region", "r_regionkey")]


def _subset(spark: SparkSession, sf: str) -> DataFrame:
    names = ["customer", "orders", "lineitem", "part", "supplier", "nation", "region"]
    sel = consistent_subset({n: table(spark, sf, n) for n in names}, "customer", "c_custkey",
                            SUBSET_FRACTION, SEED, DOWN, UP)
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for n, df in sel.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _subset_sql() -> str:
    seed = derive_seed(SEED, "customer", "__subset__", "c_custkey")
    roots = (f"SELECT c_custkey FROM ({G.draws_sql('SELECT c_custkey FROM customer', 'c_custkey', {'__pick': seed})}) "
             f"WHERE __pick < {unit_cut(SUBSET_FRACTION)}")
    return (
        f"WITH c AS ({roots}), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), "
        "l AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), "
        "s AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)), "
        "n AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey IN ("
        "SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT c_custkey FROM c)) "
        "OR n_nationkey IN (SELECT s_nationkey FROM s)) "
        "SELECT 'customer' AS table_name, count(*) AS row_count FROM c UNION ALL "
        "SELECT 'orders', count(*) FROM o UNION ALL "
        "SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) UNION ALL "
        "SELECT 'part', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM l) UNION ALL "
        "SELECT 'supplier', count(*) FROM s UNION ALL SELECT 'nation', count(*) FROM n UNION ALL "
        "SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)")


# --- dataset diff (X09) and schema drift (X10) ------------------------------------------------

def _orders_v2(orders: DataFrame) -> DataFrame:
    return (orders.where(F.col("o_orderstatus") != "P")
            .withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT",
                                               F.round("o_totalprice", -3)).otherwise(F.col("o_totalprice"))))


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return dataset_diff(o, _orders_v2(o), ["o_orderkey"])


ORDERS_V2_SQL = ("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' "
                 "THEN round(o_totalprice, -3) ELSE o_totalprice END AS o_totalprice, o_orderdate, "
                 "o_orderpriority FROM orders WHERE o_orderstatus <> 'P'")
_DIFF_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_both = "a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL"
DIFF_SQL = (
    f"WITH j AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, "
    + ", ".join(f"{_both} AND a.{c} IS DISTINCT FROM b.{c} AS ch_{c}" for c in _DIFF_COLS)
    + f" FROM orders AS a FULL OUTER JOIN ({ORDERS_V2_SQL}) AS b ON a.o_orderkey = b.o_orderkey) "
    "SELECT '__rows__' AS column_name, count(*) FILTER (WHERE ka IS NULL) AS added, "
    "count(*) FILTER (WHERE kb IS NULL) AS removed, count(*) FILTER (WHERE "
    + " OR ".join(f"ch_{c}" for c in _DIFF_COLS) + ") AS changed FROM j"
    + "".join(f" UNION ALL SELECT {q(c)}, CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*) FILTER (WHERE ch_{c}) FROM j"
              for c in _DIFF_COLS))


def _drift(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    v2 = o.select("o_orderkey", "o_custkey", "o_orderstatus",
                  F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderdate",
                  F.lit(None).cast("string").alias("o_comment"))
    return schema_drift(o, v2)


_SPARK_TYPE = ("CASE {t} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
               "WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower({t}) END")
DRIFT_SQL = (
    "WITH a AS (SELECT column_name, " + _SPARK_TYPE.format(t="column_type") + " AS t, row_number() OVER () AS i "
    "FROM (DESCRIBE SELECT * FROM orders)), "
    "b AS (SELECT column_name, " + _SPARK_TYPE.format(t="column_type") + " AS t FROM (DESCRIBE SELECT o_orderkey, "
    "o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, o_orderdate, "
    "CAST(NULL AS VARCHAR) AS o_comment FROM orders)) "
    "SELECT coalesce(a.column_name, b.column_name) AS column_name, a.t AS first_type, b.t AS second_type, "
    "CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' WHEN a.t = b.t THEN 'same' "
    "ELSE 'changed' END AS status, CASE WHEN a.column_name = 'o_totalprice' THEN (SELECT count(*) FILTER "
    "(WHERE o_totalprice IS NOT NULL AND CAST(TRY_CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) IS DISTINCT "
    "FROM o_totalprice) FROM orders) END AS lossy_values "
    "FROM a FULL OUTER JOIN b ON a.column_name = b.column_name")


# --- fidelity (X07) ---------------------------------------------------------------------------

def _fidelity(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    f, op = o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_orderstatus") == "O")
    cat = category_fidelity(f, op, "o_orderpriority").select(
        "column_name", F.round("tvd", 9).alias("tvd"), F.lit(None).cast("double").alias("ks"),
        F.lit(None).cast("double").alias("psi"), F.round("unseen_share", 9).alias("unseen_share"))
    num = numeric_fidelity(f, op, "o_totalprice").select(
        "column_name", F.round("tvd", 9).alias("tvd"), F.round("ks", 9).alias("ks"),
        F.round("psi", 9).alias("psi"), F.lit(None).cast("double").alias("unseen_share"))
    return cat.unionByName(num)


FIDELITY_SQL = (
    "WITH p AS (SELECT o_orderpriority AS v, count(*) AS np FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), "
    "q AS (SELECT o_orderpriority AS v, count(*) AS nq FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), "
    "t AS (SELECT (SELECT sum(np) FROM p) AS tp, (SELECT sum(nq) FROM q) AS tq), "
    "cat AS (SELECT 'o_orderpriority' AS column_name, round(sum(abs(coalesce(np, 0) / tp - coalesce(nq, 0) / tq)) / 2, 9) AS tvd, "
    "CAST(NULL AS DOUBLE) AS ks, CAST(NULL AS DOUBLE) AS psi, "
    "round(coalesce(sum(CASE WHEN nq IS NULL THEN coalesce(np, 0) / tp END), 0), 9) AS unseen_share "
    "FROM p FULL OUTER JOIN q ON p.v = q.v, t), "
    "r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderstatus = 'F'), "
    "hb AS (SELECT o_orderstatus AS s, CAST(least(greatest(floor((o_totalprice - lo) / ((hi - lo) / 20)), 0), 19) AS INTEGER) AS bin "
    "FROM orders, r WHERE o_orderstatus IN ('F', 'O') AND o_totalprice IS NOT NULL), "
    "g AS (SELECT range::INTEGER AS bin FROM range(20)), "
    "h AS (SELECT g.bin, (SELECT count(*) FROM hb WHERE hb.s = 'F' AND hb.bin = g.bin) AS np, "
    "(SELECT count(*) FROM hb WHERE hb.s = 'O' AND hb.bin = g.bin) AS nq FROM g), "
    "h2 AS (SELECT bin, np / sum(np) OVER () AS p, nq / sum(nq) OVER () AS q FROM h), "
    "h3 AS (SELECT *, sum(p) OVER (ORDER BY bin) AS cp, sum(q) OVER (ORDER BY bin) AS cq FROM h2), "
    "num AS (SELECT 'o_totalprice' AS column_name, round(sum(abs(p - q)) / 2, 9) AS tvd, "
    "round(max(abs(cp - cq)), 9) AS ks, round(sum((greatest(q, 1e-6) - greatest(p, 1e-6)) * "
    "ln(greatest(q, 1e-6) / greatest(p, 1e-6))), 9) AS psi, CAST(NULL AS DOUBLE) AS unseen_share FROM h3) "
    "SELECT * FROM cat UNION ALL SELECT * FROM num")


# --- coverage (X11) ---------------------------------------------------------------------------

STATUS_DOMAIN = ["F", "O", "P", "X"]
PRIORITY_DOMAIN = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    return pair_coverage(table(spark, sf, "orders"), "o_orderstatus", STATUS_DOMAIN,
                         "o_orderpriority", PRIORITY_DOMAIN)


COVERAGE_SQL = (
    "SELECT d.o_orderstatus, d.o_orderpriority, coalesce(c.n, 0) AS rows FROM (VALUES "
    + ", ".join(f"({q(a)}, {q(b)})" for a in STATUS_DOMAIN for b in PRIORITY_DOMAIN)
    + ") AS d(o_orderstatus, o_orderpriority) LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n "
    "FROM orders GROUP BY 1, 2) AS c ON c.o_orderstatus = d.o_orderstatus AND c.o_orderpriority = d.o_orderpriority")


def _value_cov(spark: SparkSession, sf: str) -> DataFrame:
    return value_coverage(table(spark, sf, "orders"), "o_orderpriority", PRIORITY_DOMAIN)


VALUE_COVERAGE_SQL = (
    "SELECT d.o_orderpriority, coalesce(c.n, 0) AS rows FROM (VALUES "
    + ", ".join(f"({q(v)})" for v in PRIORITY_DOMAIN)
    + ") AS d(o_orderpriority) LEFT JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) "
    "AS c ON c.o_orderpriority = d.o_orderpriority")


def _boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return boundary_coverage(table(spark, sf, "part"), "p_size", 1, 50)


BOUNDARY_SQL = ("SELECT 'p_size' AS column_name, count(*) FILTER (WHERE p_size = 1) AS at_low, "
                "count(*) FILTER (WHERE p_size = 50) AS at_high, count(*) FILTER (WHERE p_size > 1 AND "
                "p_size < 50) AS inside FROM part")


# --- PII scan (X15) and verbatim leakage (X08) ----------------------------------------------

PII_TABLES = {"documents": ["text", "lang", "source"], "conversations": ["role", "text"],
              "pages": ["url", "html"], "benchmark": ["text"], "events": ["event_type", "props"]}


def _pii(spark: SparkSession, sf: str) -> DataFrame:
    parts = [pii_scan(table(spark, sf, n), n) for n in PII_TABLES]
    return reduce(DataFrame.unionByName, parts)


PII_SQL = " UNION ALL ".join(
    f"SELECT {q(t)} AS table_name, {q(c)} AS column_name, {q(k)} AS pii_kind, "
    f"count(*) FILTER (WHERE regexp_matches({c}, {q(p)})) AS matching_rows, count(*) AS total_rows FROM {t}"
    for t, cols in PII_TABLES.items() for c in cols for k, p in PII_PATTERNS.items())


def _leak(spark: SparkSession, sf: str) -> DataFrame:
    return verbatim_leakage(table(spark, sf, "documents"), table(spark, sf, "conversations"),
                            ["text"], ["text"])


LEAK_SQL = ("SELECT coalesce(sum(n), 0)::BIGINT AS leaked_rows, count(*) AS leaked_values FROM "
            "(SELECT text, count(*) AS n FROM conversations GROUP BY text) AS c "
            "WHERE text IN (SELECT text FROM documents)")


# --- row edits (X16) ------------------------------------------------------------------------

EDIT_THRESHOLD = 400000
TPC_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EDIT_TEST = DataTest("enum", "orders", "o_orderpriority", {"values": TPC_PRIORITIES})


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    edits = o.where(F.col("o_totalprice") > EDIT_THRESHOLD).select(
        "o_orderkey", F.lit("o_orderpriority").alias("column"), F.lit("0-EDITED").alias("value"))
    return run_tests({"orders": apply_edits(o, ["o_orderkey"], edits)}, [EDIT_TEST])


EDITS_SQL = report_sql(
    EDIT_TEST.test_id, "enum", "orders", "o_orderpriority", "constraint", "bad = 0", "bad",
    "'values outside the allowed set: [' || coalesce(ex, '') || ']'",
    "WITH e AS (SELECT CASE WHEN o_totalprice > " + str(EDIT_THRESHOLD) + " THEN '0-EDITED' ELSE "
    "o_orderpriority END AS v FROM orders), x AS (SELECT v, count(*) AS n FROM e WHERE v IS NOT NULL AND v NOT IN ("
    + ", ".join(q(v) for v in TPC_PRIORITIES) + ") GROUP BY v) SELECT coalesce(sum(n), 0) AS bad, "
    "(SELECT string_agg('''' || v || '''', ', ' ORDER BY v) FROM x) AS ex FROM x")


# --- empirical resampling (X03) ----------------------------------------------------------------

def _empirical(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return empirical_column(o.select("o_orderkey"), "o_orderkey", table(spark, sf, "lineitem"), "l_partkey", SEED,
                            "orders_twin", "v")  # a key-like source column


def _empirical_sql() -> str:
    seeds = [derive_seed(SEED, "orders_twin", "v", *more) for more in ((), ("__draw1__",))]
    d = G.draws_sql("SELECT o_orderkey FROM orders", "o_orderkey", dict(zip(("__e0", "__e1"), seeds)))
    return ("WITH c AS (SELECT l_partkey AS value, count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1), "
            "cuts AS (SELECT value, sum(n) OVER (ORDER BY value) - n AS lo, sum(n) OVER (ORDER BY value) AS hi FROM c) "
            f"SELECT r.o_orderkey, cuts.value AS v FROM (SELECT o_orderkey, {G.draw63(['__e0', '__e1'])} % "
            f"(SELECT sum(n) FROM c) AS e FROM ({d})) AS r JOIN cuts ON r.e >= cuts.lo AND r.e < cuts.hi")


# --- self-referencing key (X13) -----------------------------------------------------------------

EMPLOYEES = parse_spec({"seed": SEED, "tables": [{
    "name": "employees", "row_count": 0, "primary_key": ["id"],
    "foreign_keys": [{"column": "manager_id", "references_table": "employees", "references_column": "id"}],
    "columns": [
        {"name": "id", "type": "bigint", "generator": {"kind": "serial", "params": {"start": 1}}},
        {"name": "manager_id", "type": "bigint", "nullable": True, "generator": {"kind": "fk", "params": {}}},
        {"name": "name", "type": "text", "generator": {"kind": "faker", "params": {"method": "name"}}}]}]})


def _self_fk(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "customer").count()
    return generate_dataset(spark, EMPLOYEES, row_counts={"employees": n})["employees"]


def _self_fk_sql() -> str:
    seeds = [derive_seed(SEED, "employees", "__self_fk__", "manager_id", *more) for more in ((), ("__draw1__",))]
    base = G.draws_sql("SELECT range AS __row FROM range((SELECT count(*) FROM customer))", "__row",
                       dict(zip(("__sf0", "__sf1"), seeds)))
    return table_sql(EMPLOYEES.table("employees"), SEED, base, [],
                     {"manager_id": f"CASE WHEN __row = 0 THEN NULL ELSE 1 + {G.draw63(['__sf0', '__sf1'])} % __row END"})


# --- report score (X06) and column profile (X02) --------------------------------------------------

def _score(spark: SparkSession, sf: str) -> DataFrame:
    s = score_report(run_tests(suite_tables(spark, sf), T_SUITE))
    return s.select("tests", "passed", "failed", F.round("score", 9).alias("score"))


def _score_sql() -> str:
    w = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in SEVERITY.items())
    return (f"SELECT count(*) AS tests, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) "
            f"AS failed, round(coalesce(sum(CASE WHEN passed THEN CASE category {w} ELSE 1.0 END ELSE 0.0 END) / "
            f"sum(CASE category {w} ELSE 1.0 END), 1.0), 9) AS score FROM ({suite_sql(T_SUITE)})")


QUERIES = {
    "cross_field": _rules,
    "subset_ri": _subset,
    "dataset_diff": _diff,
    "schema_drift": _drift,
    "fidelity_tvd": _fidelity,
    "coverage_pairs": _coverage,
    "coverage_values": _value_cov,
    "coverage_boundaries": _boundaries,
    "pii_scan": _pii,
    "leak_check": _leak,
    "row_edits": _edits,
    "gen_empirical": _empirical,
    "self_fk": _self_fk,
    "report_score": _score,
}
ORACLE = {
    "cross_field": _rules_sql(),
    "subset_ri": _subset_sql(),
    "dataset_diff": DIFF_SQL,
    "schema_drift": DRIFT_SQL,
    "fidelity_tvd": FIDELITY_SQL,
    "coverage_pairs": COVERAGE_SQL,
    "coverage_values": VALUE_COVERAGE_SQL,
    "coverage_boundaries": BOUNDARY_SQL,
    "pii_scan": PII_SQL,
    "leak_check": LEAK_SQL,
    "row_edits": EDITS_SQL,
    "gen_empirical": _empirical_sql(),
    "self_fk": _self_fk_sql(),
    "report_score": _score_sql(),
}
