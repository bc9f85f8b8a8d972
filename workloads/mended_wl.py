"""Jobs whose data provoke the answers that are easy to get silently wrong; their oracle SQL is
written out on its own, without the engine's helpers.

Wide integer spans, NULL in an allow-list, numeric bounds on text, tests that cannot run, columns
that child and parent share, corrupt JSON lines, edits that change nothing, NULL keys in a diff,
build order by level.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.generators import register
from ferrule.operators.compare import dataset_diff
from ferrule.operators.datatests import DataTest, run_tests
from ferrule.operators.edits import unapplied_edits
from ferrule.operators.generate import generate_columns, unique_violations
from ferrule.operators.twin import gate
from ferrule.plans.spec import build_order, parse_spec
from ferrule.session import scratch_path
from ferrule.sources.readers import corrupt_lines, read_jsonl

from .common import table

SEED = 42


# --- wide spans ---------------------------------------------------------------------------------

SPANS = {"three_billion": (0, 2_999_999_999), "whole_int64": (-(1 << 63), (1 << 63) - 1)}


def _int_span(spark: SparkSession, sf: str) -> DataFrame:
    """Integers over a span of 3·10^9 and over all of INT64, drawn by order key, and whether each is
    in the lower half of its span."""
    spec = parse_spec({"seed": SEED, "tables": [{"name": "spans", "row_count": 0, "columns": [
        {"name": n, "type": "bigint", "generator": {"kind": "int_range", "params": {"low": lo, "high": hi}}}
        for n, (lo, hi) in SPANS.items()]}]})
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("__row"), "o_orderkey")
    out = generate_columns(base, spec.table("spans"), SEED, keep=["o_orderkey"])
    halves = [(F.col(n) < (lo + hi + 1) // 2).alias(f"{n}_low") for n, (lo, hi) in SPANS.items()]
    return out.select("o_orderkey", *SPANS, *halves)


def _int_span_sql() -> str:
    def seed_of(*labels: str) -> int:
        h = hashlib.blake2b(digest_size=8)
        for part in (str(SEED), *labels):
            h.update(len(part).to_bytes(8, "big") + part.encode())
        return int.from_bytes(h.digest(), "big")

    def r(x: str) -> str:
        return f"((xor({x}, {x} >> 16) * 73244475) & 4294967295)"

    draws = [(f"{n}_{k}", seed_of("spans", n, *([f"__draw{k}__"] if k else [])))
             for n, count in (("three_billion", 2), ("whole_int64", 4)) for k in range(count)]
    sql = "SELECT o_orderkey, " + ", ".join(
        f"(xor(o_orderkey, {s & 0x7FFFFFFF}) & 4294967295) AS {n}" for n, s in draws) + " FROM orders"
    steps = [{n: r(n) for n, _ in draws}] * 2
    steps.append({n: f"(xor(xor(xor({n}, {n} >> 16), {s >> 32 & 0x7FFFFFFF}), o_orderkey >> 32) & 4294967295)" for n, s in draws})
    steps += [{n: r(n) for n, _ in draws}] * 2
    steps.append({n: f"xor({n}, {n} >> 16)" for n, _ in draws})
    for step in steps:
        sql = "SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in step.items()) + f" FROM ({sql})"

    def pair(n: str, k: int) -> str:
        return f"(({n}_{k} << 31) | ({n}_{k + 1} >> 1))"

    big = (f"(CAST('-9223372036854775808' AS HUGEINT) + (CAST({pair('whole_int64', 0)} AS HUGEINT) * 9223372036854775808 + "
           f"{pair('whole_int64', 2)}) % 18446744073709551616)")
    sql = (f"SELECT o_orderkey, {pair('three_billion', 0)} % 3000000000 AS three_billion, "
           f"CAST({big} AS BIGINT) AS whole_int64 FROM ({sql})")
    return f"SELECT *, three_billion < 1500000000 AS three_billion_low, whole_int64 < 0 AS whole_int64_low FROM ({sql})"


# --- data tests ---------------------------------------------------------------------------------

def _report(spark: SparkSession, sf: str, tests: list[DataTest], names: list[str]) -> DataFrame:
    out = run_tests({n: table(spark, sf, n) for n in names}, tests)
    return out.select("kind", "category", "passed", "bad_count")


def _enum_null_list(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf, [DataTest("enum", "orders", "o_orderstatus", {"values": ["F", "O", None]})], ["orders"])


ENUM_NULL_LIST_SQL = """
SELECT 'enum' AS kind, 'constraint' AS category, count(*) = 0 AS passed, count(*) AS bad_count
FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')"""


def _text_range(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("nation"))
    return run_tests({"c": c}, [DataTest("value_range", "c", "nation", {"min": "5", "max": "20"})]).select(
        "kind", "category", "passed", "bad_count")


TEXT_RANGE_SQL = """
SELECT 'value_range' AS kind, 'constraint' AS category, count(*) = 0 AS passed, count(*) AS bad_count
FROM customer WHERE c_nationkey < 5 OR c_nationkey > 20"""


def _unknown(spark: SparkSession, sf: str) -> DataFrame:
    tests = [DataTest("uniqueness", "orders", "o_orderkey", {}), DataTest("unique", "order", "o_orderkey", {}),
             DataTest("unique", "orders", "o_orderkey", {})]
    return _report(spark, sf, tests, ["orders"])


UNKNOWN_SQL = """
SELECT 'uniqueness' AS kind, 'skipped' AS category, FALSE AS passed, CAST(NULL AS BIGINT) AS bad_count
UNION ALL SELECT 'unique', 'skipped', FALSE, CAST(NULL AS BIGINT)
UNION ALL SELECT 'unique', 'uniqueness', count(*) = count(DISTINCT o_orderkey), count(*) - count(DISTINCT o_orderkey) FROM orders"""


def _same_names(spark: SparkSession, sf: str) -> DataFrame:
    """Child and parent both have ``id`` and ``amount``."""
    child = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount"))
    parent = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    test = DataTest("cross_field", "child", "amount", {"ref_table": "parent", "on": [["id", "id"]],
                                                       "expr": "child.amount <= parent.amount"})
    return run_tests({"child": child, "parent": parent}, [test]).select("kind", "category", "passed", "bad_count")


SAME_NAMES_SQL = """
SELECT 'cross_field' AS kind, 'cross_table' AS category, count(*) = 0 AS passed, count(*) AS bad_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice > o_totalprice"""


# --- readers, edits, diffs, order -----------------------------------------------------------------

def _jsonl_corrupt(spark: SparkSession, sf: str) -> DataFrame:
    """Nation names as JSON lines, those of region 1 cut off: how many lines are corrupt, and how
    many rows a lenient read has with and without a name."""
    path = scratch_path(spark, f"corrupt-{uuid.uuid4().hex[:12]}")
    line = F.to_json(F.struct(F.col("n_nationkey"), F.col("n_name")))
    lines = table(spark, sf, "nation").select(
        F.when(F.col("n_regionkey") == 1, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    lines.write.text(path)
    bad = corrupt_lines(spark, path, ["n_nationkey", "n_name"]).agg(F.count(F.lit(1)).alias("corrupt"))
    rows = read_jsonl(spark, path, {"n_nationkey": "bigint", "n_name": "text"}, strict=False)
    return rows.agg(F.count(F.lit(1)).alias("rows_read"), F.count("n_name").alias("named")).crossJoin(bad)  # one row each


JSONL_CORRUPT_SQL = """
SELECT count(*) AS rows_read, count(*) FILTER (WHERE n_regionkey <> 1) AS named,
       count(*) FILTER (WHERE n_regionkey = 1) AS corrupt FROM nation"""


def _edits_unapplied(spark: SparkSession, sf: str) -> DataFrame:
    """An edit a customer: every third to a column that is not there, every fifth to a key that is
    not there, every seventh to the key itself."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    edits = c.select(F.when(k % 5 == 0, -k).otherwise(k).alias("c_custkey"),
                     F.when(k % 7 == 0, "c_custkey").when(k % 3 == 0, "c_colour").otherwise("c_name").alias("column"),
                     F.lit("x").alias("value"))
    return unapplied_edits(c, ["c_custkey"], edits).select("c_custkey", "column", "reason")


EDITS_UNAPPLIED_SQL = """
SELECT * FROM (
  SELECT CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey,
         CASE WHEN c_custkey % 7 = 0 THEN 'c_custkey' WHEN c_custkey % 3 = 0 THEN 'c_colour' ELSE 'c_name' END AS "column",
         CASE WHEN c_custkey % 7 = 0 THEN 'key_column' WHEN c_custkey % 3 = 0 THEN 'no_such_column'
              WHEN c_custkey % 5 = 0 AND c_custkey <> 0 THEN 'no_such_key' END AS reason FROM customer)
WHERE reason IS NOT NULL"""


def _diff_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers against themselves, one key NULL on both sides, balances of nation 3 changed."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    first = s.select(F.when(k != 7, k).alias("k"), "s_nationkey", "s_acctbal")
    second = first.withColumn("s_acctbal", F.when(F.col("s_nationkey") == 3, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return dataset_diff(first, second, ["k"])


DIFF_NULL_KEYS_SQL = """
SELECT '__rows__' AS column_name, 0 AS added, 0 AS removed, count(*) FILTER (WHERE s_nationkey = 3) AS changed FROM supplier
UNION ALL SELECT 's_nationkey', 0, 0, 0
UNION ALL SELECT 's_acctbal', 0, 0, count(*) FILTER (WHERE s_nationkey = 3) FROM supplier"""


def _dataset_order(spark: SparkSession, sf: str) -> DataFrame:
    """Build order of items -> notes, notes, tags, and each table's rows in the given tables."""
    key = {"name": "id", "type": "bigint", "generator": {"kind": "serial", "params": {"start": 1}}}
    spec = parse_spec({"seed": SEED, "tables": [
        {"name": "lineitem", "primary_key": ["id"], "foreign_keys": [
            {"column": "o", "references_table": "orders", "references_column": "id"}],
         "columns": [key, {"name": "o", "type": "bigint", "generator": {"kind": "fk", "params": {}}}]},
        {"name": "orders", "row_count": 1, "primary_key": ["id"], "columns": [key]},
        {"name": "part", "row_count": 1, "primary_key": ["id"], "columns": [key]}]})
    parts = [table(spark, sf, name).agg(F.lit(i).alias("place"), F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
             for i, name in enumerate(build_order(spec))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


DATASET_ORDER_SQL = """
SELECT 0 AS place, 'orders' AS table_name, count(*) AS n FROM orders
UNION ALL SELECT 1, 'part', count(*) FROM part UNION ALL SELECT 2, 'lineitem', count(*) FROM lineitem"""


# --- registry, uniqueness, gate -------------------------------------------------------------------

def _register_generator(spark: SparkSession, sf: str) -> DataFrame:
    """A generator kind of one's own, named by a spec: even numbers below a bound."""
    register("even_below", lambda p: 1, lambda p, ctx: ctx.draws[0] % F.lit(int(p["half"])).cast("long") * 2, {"INT64"})
    spec = parse_spec({"seed": SEED, "tables": [{"name": "evens", "row_count": 0, "columns": [
        {"name": "v", "type": "bigint", "generator": {"kind": "even_below", "params": {"half": 50}}}]}]})
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("__row"), "o_orderkey")
    out = generate_columns(base, spec.table("evens"), SEED, keep=["o_orderkey"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("v") % 2 == 0) & F.col("v").between(0, 98)).alias("fitting"),
                   F.count_distinct("v").alias("kinds"))


REGISTER_SQL = "SELECT count(*) AS n, count(*) AS fitting, 50 AS kinds FROM orders"


def _unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a table that declares three columns unique."""
    spec = parse_spec({"seed": SEED, "tables": [{"name": "lines", "row_count": 1, "columns": [
        {"name": n, "type": "bigint", "unique": True, "generator": {"kind": "serial", "params": {"start": 1}}}
        for n in ("l_orderkey", "l_partkey", "l_suppkey")]}]})
    return unique_violations(table(spark, sf, "lineitem"), spec.table("lines"))


UNIQUE_VIOLATIONS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE n > 1) AS repeated_values, "
    f"CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS surplus_rows "
    f"FROM (SELECT {c}, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1)"
    for c in ("l_orderkey", "l_partkey", "l_suppkey"))


def _gate_status(spark: SparkSession, sf: str) -> DataFrame:
    """Orders gated by a test that passes and by one that does not: status and rows written."""
    orders = {"orders": table(spark, sf, "orders")}
    parts = []
    for name, top in (("loose", "1e12"), ("tight", "1000")):
        report = run_tests(orders, [DataTest("value_range", "orders", "o_totalprice", {"min": "0", "max": top})])
        path = scratch_path(spark, f"gate-{uuid.uuid4().hex[:12]}")
        status = gate(report, orders, path)
        folder = {"ready": "ready", "quarantined": "quarantine"}[status]
        parts.append(spark.read.parquet(f"{path}/{folder}/orders").agg(
            F.lit(name).alias("suite"), F.lit(status).alias("status"), F.count(F.lit(1)).alias("rows_written")))
    return parts[0].unionByName(parts[1])


GATE_SQL = """
SELECT 'loose' AS suite, CASE WHEN max(o_totalprice) <= 1e12 AND min(o_totalprice) >= 0 THEN 'ready' ELSE 'quarantined' END AS status,
       count(*) AS rows_written FROM orders
UNION ALL SELECT 'tight', CASE WHEN max(o_totalprice) <= 1000 AND min(o_totalprice) >= 0 THEN 'ready' ELSE 'quarantined' END, count(*) FROM orders"""


QUERIES = {
    "register_generator": _register_generator,
    "unique_violations": _unique_violations,
    "gate_status": _gate_status,
    "gen_int_span": _int_span,
    "dt_enum_null_list": _enum_null_list,
    "dt_text_range": _text_range,
    "dt_unknown": _unknown,
    "cross_field_same_names": _same_names,
    "jsonl_corrupt": _jsonl_corrupt,
    "edits_unapplied": _edits_unapplied,
    "diff_null_keys": _diff_null_keys,
    "dataset_order": _dataset_order,
}

ORACLE = {
    "register_generator": REGISTER_SQL,
    "unique_violations": UNIQUE_VIOLATIONS_SQL,
    "gate_status": GATE_SQL,
    "gen_int_span": _int_span_sql(),
    "dt_enum_null_list": ENUM_NULL_LIST_SQL,
    "dt_text_range": TEXT_RANGE_SQL,
    "dt_unknown": UNKNOWN_SQL,
    "cross_field_same_names": SAME_NAMES_SQL,
    "jsonl_corrupt": JSONL_CORRUPT_SQL,
    "edits_unapplied": EDITS_UNAPPLIED_SQL,
    "diff_null_keys": DIFF_NULL_KEYS_SQL,
    "dataset_order": DATASET_ORDER_SQL,
}
