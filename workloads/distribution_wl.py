"""Jobs over whole distributions and single rows: exact profiles, inverse-distribution and normal draws,
twins that follow observed counts, two-sample distances, diffs of tables with repeated keys, failing
rows of every kind of test, and the answers that NULL keys, NaN, text keys and empty sides provoke.

Their oracle SQL is written out on its own, without the engine's helpers."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.compare import category_fidelity, dataset_diff, numeric_fidelity
from ferrule.operators.datatests import DataTest, failing_samples, run_tests
from ferrule.operators.distribution import two_sample_distance
from ferrule.operators.edits import apply_edits
from ferrule.operators.empirical import quantile_column
from ferrule.operators.generate import generate_columns
from ferrule.operators.profile import profile_columns, suggest_rules
from ferrule.operators.twin import make_twin
from ferrule.plans.spec import parse_spec
from ferrule.session import run_concurrently, scratch_path

from .common import table

SEED = 42


def _seed_of(*labels: str) -> int:
    h = hashlib.blake2b(digest_size=8)
    for part in (str(SEED), *labels):
        h.update(len(part).to_bytes(8, "big") + part.encode())
    return int.from_bytes(h.digest(), "big")


def _draws(source: str, index: str, seeds: dict[str, int], keep: str) -> str:
    """Draws (32 bits) of ``index``, a column of the subquery ``source``, as columns next to ``keep``."""
    def r(x: str) -> str:
        return f"((xor({x}, {x} >> 16) * 73244475) & 4294967295)"

    steps = [{n: f"(xor({index}, {s & 0x7FFFFFFF}) & 4294967295)" for n, s in seeds.items()}]
    steps += [{n: r(n) for n in seeds}] * 2
    steps.append({n: f"(xor(xor(xor({n}, {n} >> 16), {s >> 32 & 0x7FFFFFFF}), {index} >> 32) & 4294967295)" for n, s in seeds.items()})
    steps += [{n: r(n) for n in seeds}] * 2
    steps.append({n: f"xor({n}, {n} >> 16)" for n in seeds})
    sql = source
    for step in steps:
        sql = f"SELECT {keep}, " + ", ".join(f"{e} AS {n}" for n, e in step.items()) + f" FROM ({sql})"
    return sql


# --- exact profiles (X02) -----------------------------------------------------------------------

PROFILED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
}
NOT_NUMBERS = {"o_orderstatus", "o_orderdate", "o_orderpriority", "l_returnflag", "l_linestatus", "l_shipdate", "c_name",
               "c_mktsegment", "p_name", "p_brand", "p_type"}


def _flat_profile(df: DataFrame, name: str) -> DataFrame:
    top = F.array_join(F.transform("top_values", lambda x: F.concat(x["v"], F.lit(":"), x["count"].cast("string"))), "|")
    return profile_columns(df, 5).select(
        F.lit(name).alias("table_name"), "column_name", "rows", "nulls", "null_rate", "distinct_values", "min_value", "max_value",
        *[F.col("quartiles")[k].alias(f"q{25 * (k + 1)}") for k in range(3)], top.alias("top_values"))


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    tables = {name: table(spark, sf, name) for name in PROFILED}
    tables["customer"] = tables["customer"].withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))  # with NULLs
    return reduce(DataFrame.unionByName, run_concurrently([lambda n=n, df=df: _flat_profile(df, n) for n, df in tables.items()]))


def _profile_sql() -> str:
    parts = []
    for name, columns in PROFILED.items():
        for c in columns:
            v = "CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END" if c == "c_acctbal" else c
            q = (f"min(v) FILTER (start < (m * {k} + 3) // 4 AND (m * {k} + 3) // 4 <= start + n)" for k in (1, 2, 3))
            quart = ", ".join("CAST(NULL AS DOUBLE)" if c in NOT_NUMBERS else f"CAST({x} AS DOUBLE)" for x in q)
            a, b, d = quart.split(", CAST(")[0], *["CAST(" + x for x in quart.split(", CAST(")[1:]]
            parts.append(
                f"(WITH g AS (SELECT {v} AS v, count(*) AS n FROM {name} GROUP BY 1), "
                "o AS (SELECT v, n, sum(n) OVER (ORDER BY v) - n AS start, sum(n) OVER () AS m, "
                "row_number() OVER (ORDER BY n DESC, CAST(v AS VARCHAR)) AS place FROM g WHERE v IS NOT NULL), "
                "t AS (SELECT (SELECT sum(n) FROM g) AS r, (SELECT coalesce(sum(n), 0) FROM g WHERE v IS NULL) AS z) "
                f"SELECT '{name}' AS table_name, '{c}' AS column_name, CAST(any_value(r) AS BIGINT) AS rows, CAST(any_value(z) AS BIGINT) AS nulls, "
                "CAST(any_value(z) AS DOUBLE) / any_value(r) AS null_rate, count(*) AS distinct_values, "
                f"CAST(min(v) AS VARCHAR) AS min_value, CAST(max(v) AS VARCHAR) AS max_value, {a} AS q25, {b} AS q50, {d} AS q75, "
                "string_agg(CAST(v AS VARCHAR) || ':' || n, '|' ORDER BY place) FILTER (place <= 5) AS top_values FROM o, t)")
    return " UNION ALL ".join(parts)


# --- draws from distributions (X03) -------------------------------------------------------------

def _quantile(spark: SparkSession, sf: str) -> DataFrame:
    """Account balances between the observed ones, by order key."""
    base = table(spark, sf, "orders").select("o_orderkey")
    out = quantile_column(base, "o_orderkey", table(spark, sf, "customer"), "c_acctbal", SEED, "orders", "balance")
    return out.select("o_orderkey", F.round("balance", 6).alias("balance"))


def _quantile_sql() -> str:
    seeds = {f"d{k}": _seed_of("orders", "balance", *([f"__draw{k}__"] if k else [])) for k in range(3)}
    return (
        "WITH g AS (SELECT c_acctbal AS v, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1), "
        "c AS (SELECT v, n, sum(n) OVER (ORDER BY v) - n AS lo, lead(v) OVER (ORDER BY v) AS nx, sum(n) OVER () AS m FROM g), "
        f"d AS ({_draws('SELECT o_orderkey FROM orders', 'o_orderkey', seeds, 'o_orderkey')}), "
        "e AS (SELECT o_orderkey, ((d0 << 31) | (d1 >> 1)) % (SELECT CAST(max(m) AS BIGINT) FROM c) AS u, d2 FROM d) "
        "SELECT o_orderkey, round(coalesce(v + (nx - v) * (((u - CAST(lo AS BIGINT)) + d2 / 4294967296.0::DOUBLE) / n), v), 6) AS balance "
        "FROM e ASOF JOIN c ON e.u >= c.lo")


NORMALS = {"amount": ("decimal(18,4)", {"mean": 100, "std": 15}), "visits": ("bigint", {"mean": 50, "std": 20, "low": 20, "high": 80})}


def _normal(spark: SparkSession, sf: str) -> DataFrame:
    """Normally distributed amounts, and visits that are cut at their bounds, by order key."""
    spec = parse_spec({"seed": SEED, "tables": [{"name": "normals", "row_count": 0, "columns": [
        {"name": n, "type": t, "generator": {"kind": "normal", "params": p}} for n, (t, p) in NORMALS.items()]}]})
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("__row"), "o_orderkey")
    return generate_columns(base, spec.table("normals"), SEED, keep=["o_orderkey"])


def _normal_sql() -> str:
    seeds = {f"{n}_{k}": _seed_of("normals", n, *([f"__draw{k}__"] if k else [])) for n in NORMALS for k in range(2)}
    z = "sqrt(-2 * ln(({0}_0 + 0.5::DOUBLE) / 4294967296)) * cos(2 * pi() * ({0}_1 / 4294967296::DOUBLE))"
    return (f"SELECT o_orderkey, CAST(CAST(floor((100 + 15 * {z.format('amount')}) * 10000 + 0.5) AS BIGINT) / 10000::DOUBLE AS DECIMAL(18, 4)) AS amount, "
            f"least(greatest(CAST(floor(50 + 20 * {z.format('visits')} + 0.5) AS BIGINT), 20), 80) AS visits "
            f"FROM ({_draws('SELECT o_orderkey FROM orders', 'o_orderkey', seeds, 'o_orderkey')})")


# --- twins that follow the source (G28) ---------------------------------------------------------

def _twin(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and their orders, a third of which belong to one customer, against their twin: parents by number
    of children, NULL statuses, rows."""
    parents = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    hot = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("o_custkey")).cast("long")
    children = table(spark, sf, "orders").select(
        "o_orderkey", hot.alias("o_custkey"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    twin = make_twin(spark, {"customer": parents, "orders": children}, {"customer": ["c_custkey"], "orders": ["o_orderkey"]},
                     {"orders": [{"column": "o_custkey", "references_table": "customer", "references_column": "c_custkey"}]},
                     SEED, observed=True, materialize_dir=scratch_path(spark, f"twin-observed-{hashlib.md5(sf.encode()).hexdigest()[:8]}"))

    def measures(parents: DataFrame, children: DataFrame, side: str) -> DataFrame:
        per = children.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
        k = parents.select("c_custkey").join(per, "c_custkey", "left").groupBy(F.coalesce("n", F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        whole = children.agg(F.count_if(F.col("o_orderstatus").isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows"))
        none = F.lit(None).cast("long")
        return (k.select(F.lit("children").alias("measure"), "k", "n")
                .unionByName(whole.select(F.lit("nulls").alias("measure"), none.alias("k"), F.col("nulls").alias("n")))
                .unionByName(whole.select(F.lit("rows").alias("measure"), none.alias("k"), F.col("rows").alias("n"))).withColumn("side", F.lit(side)))

    both = measures(parents, children, "source").unionByName(measures(twin.data["customer"], twin.data["orders"], "twin"))
    sides = [F.coalesce(F.max(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("source", "twin")]
    return both.groupBy("measure", "k").agg(*sides)


def _twin_sql() -> str:
    seeds = {"d": _seed_of("orders", "o_orderstatus", "__nulls__")}
    return (
        "WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS p, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS s FROM orders), "
        "k AS (SELECT c_custkey, count(p) AS k FROM customer LEFT JOIN o ON p = c_custkey GROUP BY 1), "
        "w AS (SELECT count(*) AS n, count(*) FILTER (s IS NULL) AS z FROM o), "
        f"d AS ({_draws('SELECT range AS i FROM range((SELECT n FROM w))', 'i', seeds, 'i')}) "
        "SELECT 'children' AS measure, k, count(*) AS source, count(*) AS twin FROM k GROUP BY 2 "
        "UNION ALL SELECT 'rows', NULL, n, n FROM w UNION ALL "
        "SELECT 'nulls', NULL, any_value(z), count(*) FILTER (d < round(z / n::DOUBLE * 4294967296)) FROM d, w")


# --- distances between distributions (X07) ------------------------------------------------------

COMPARED = ["o_totalprice", "o_custkey", "o_orderdate", "o_orderpriority", "half", "never"]


def _sides(spark: SparkSession, sf: str) -> list[DataFrame]:
    o = table(spark, sf, "orders").withColumn("half", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 100)).withColumn(
        "never", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")))
    return [o.where(F.col("o_orderstatus") == s) for s in ("F", "O")]


def _ks(spark: SparkSession, sf: str) -> DataFrame:
    rate = [F.round(c, 12).alias(c) for c in ("ks", "null_rate_source", "null_rate_other", "null_gap", "distinct_gap")]
    return two_sample_distance(*_sides(spark, sf), COMPARED).select(
        "column_name", *rate, "values_source", "values_other", "distinct_source", "distinct_other")


def _ks_sql() -> str:
    columns = {**{c: c for c in COMPARED[:4]}, "half": "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 100 END",
               "never": "CASE WHEN o_orderstatus = 'F' THEN o_custkey END"}
    return " UNION ALL ".join(
        f"(WITH r AS (SELECT {v} AS v, o_orderstatus = 'F' AS f FROM orders WHERE o_orderstatus IN ('F', 'O')), "
        "t AS (SELECT count(v) FILTER (f) AS p, count(v) FILTER (NOT f) AS q, count(*) FILTER (f) AS rp, count(*) FILTER (NOT f) AS rq, "
        "count(DISTINCT v) FILTER (f) AS dp, count(DISTINCT v) FILTER (NOT f) AS dq FROM r), "
        "g AS (SELECT v, count(*) FILTER (f) AS np, count(*) FILTER (NOT f) AS nq FROM r WHERE v IS NOT NULL GROUP BY 1), "
        "c AS (SELECT sum(np) OVER (ORDER BY v) AS cp, sum(nq) OVER (ORDER BY v) AS cq FROM g), "
        "k AS (SELECT max(abs(cp::DOUBLE / nullif(p, 0) - cq::DOUBLE / nullif(q, 0))) AS gap FROM c, t) "
        f"SELECT '{n}' AS column_name, round(CASE WHEN p = 0 AND q = 0 THEN 0.0 WHEN p = 0 OR q = 0 THEN 1.0 ELSE gap END::DOUBLE, 12) AS ks, "
        "round((rp - p)::DOUBLE / rp, 12) AS null_rate_source, round((rq - q)::DOUBLE / rq, 12) AS null_rate_other, "
        "round(abs((rp - p)::DOUBLE / rp - (rq - q)::DOUBLE / rq), 12) AS null_gap, "
        "round(CASE WHEN greatest(dp, dq) = 0 THEN 0 ELSE 1 - least(dp, dq)::DOUBLE / greatest(dp, dq) END::DOUBLE, 12) AS distinct_gap, "
        "p AS values_source, q AS values_other, dp AS distinct_source, dq AS distinct_other FROM t, k)" for n, v in columns.items())


def _empty_side(spark: SparkSession, sf: str) -> DataFrame:
    """Distances where one side, or both, have only NULLs in the column."""
    f, o = _sides(spark, sf)
    parts = [(f, o, "one"), (o, f, "one"), (o, o, "both"), (f, f, "none")]
    out = None
    for k, (a, b, _) in enumerate(parts):
        for name, part in (("category", category_fidelity(a, b, "never")), ("numeric", numeric_fidelity(a, b, "never"))):
            row = part.select(F.lit(k).alias("part"), F.lit(name).alias("method"), "tvd")
            out = row if out is None else out.unionByName(row)
    return out


EMPTY_SIDE_SQL = """
WITH n AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS f, 0 AS o FROM orders),
p AS (SELECT unnest([0, 1, 2, 3]) AS part),
s AS (SELECT part, CASE WHEN part IN (0, 3) THEN f ELSE o END AS a, CASE WHEN part IN (1, 3) THEN f ELSE o END AS b FROM p, n)
SELECT part, method, CASE WHEN (a = 0) <> (b = 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS tvd
FROM s, (SELECT unnest(['category', 'numeric']) AS method)"""


# --- diffs with repeated keys (X09) -------------------------------------------------------------

def _diff(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by order (a key that repeats, a third of it NULL) against an edited version, and a table against itself."""
    li = table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 > 0, F.col("l_orderkey") % 5000).alias("k"), "l_linenumber", "l_quantity", "l_returnflag",
        F.col("l_orderkey").alias("o"))
    old = li.drop("o")
    kept = li.where(~((F.col("o") % 11 == 0) & (F.col("l_linenumber") == 2)))
    new = kept.withColumn("l_quantity", F.when(F.col("o") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).drop("o")
    return dataset_diff(old, new, ["k"]).withColumn("versions", F.lit("edited")).unionByName(
        dataset_diff(old, old, ["k"]).withColumn("versions", F.lit("same")))


DIFF_SQL = """
WITH li AS (SELECT CASE WHEN l_orderkey % 3 > 0 THEN l_orderkey % 5000 END AS k, l_linenumber AS l, l_quantity AS q, l_returnflag AS r, l_orderkey AS o FROM lineitem),
a AS (SELECT k, l, q, r, count(*) AS n FROM li GROUP BY ALL),
b AS (SELECT k, l, CASE WHEN o % 7 = 0 THEN q + 1 ELSE q END AS q, r, count(*) AS n FROM li WHERE NOT (o % 11 = 0 AND l = 2) GROUP BY ALL),
x AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.l, b.l) AS l, coalesce(a.q, b.q) AS q, coalesce(a.r, b.r) AS r, coalesce(a.n, 0) - coalesce(b.n, 0) AS d
      FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.l = b.l AND a.q = b.q AND a.r = b.r),
e AS (SELECT k, l, q, r, d > 0 AS f FROM x, range(CAST(abs(d) AS BIGINT))),
p AS (SELECT *, row_number() OVER (PARTITION BY k, f ORDER BY l, q, r) AS i FROM e),
j AS (SELECT f.f AS fa, s.f AS fb, f.l <> s.l AS cl, f.q <> s.q AS cq, f.r <> s.r AS cr
      FROM (SELECT * FROM p WHERE f) f FULL JOIN (SELECT * FROM p WHERE NOT f) s ON f.k IS NOT DISTINCT FROM s.k AND f.i = s.i),
t AS (SELECT count(*) FILTER (fa IS NULL) AS added, count(*) FILTER (fb IS NULL) AS removed, count(*) FILTER (fa IS NOT NULL AND fb IS NOT NULL) AS changed,
             count(*) FILTER (cl) AS cl, count(*) FILTER (cq) AS cq, count(*) FILTER (cr) AS cr FROM j)
SELECT '__rows__' AS column_name, added, removed, changed, 'edited' AS versions FROM t
UNION ALL SELECT 'l_linenumber', 0, 0, cl, 'edited' FROM t UNION ALL SELECT 'l_quantity', 0, 0, cq, 'edited' FROM t
UNION ALL SELECT 'l_returnflag', 0, 0, cr, 'edited' FROM t
UNION ALL SELECT unnest(['__rows__', 'l_linenumber', 'l_quantity', 'l_returnflag']), 0, 0, 0, 'same'"""


# --- failing rows (X06) -------------------------------------------------------------------------

FAILING = [
    DataTest("value_range", "orders", "o_totalprice", {"min": 1000, "max": 400000}),
    DataTest("enum", "orders", "o_orderstatus", {"values": ["F", "O"]}),
    DataTest("row_rule", "orders", None, {"expr": "o_custkey % 10 <> 3"}),
    DataTest("regex", "orders", "o_orderpriority", {"pattern": "^[1-4]-"}),
    DataTest("length", "orders", "o_orderpriority", {"max": 8}),
    DataTest("null_rate", "orders", "seen", {"max": 0}),
    DataTest("unique", "lineitem", "l_partkey", {}),
    DataTest("fk_cardinality", "lineitem", "l_orderkey", {"max_per_parent": 6}),
    DataTest("fk_resolves", "lineitem", "l_suppkey", {"ref_table": "supplier", "ref_column": "s_suppkey"}),
    DataTest("cross_field", "lineitem", "l_shipdate", {"ref_table": "orders", "on": [["l_orderkey", "o_orderkey"]],
                                                      "expr": "l_shipdate >= o_orderdate + INTERVAL 2 DAYS"}),
]


def _failing(spark: SparkSession, sf: str) -> DataFrame:
    """The five failing rows with the least MD5 of every test that fails."""
    tables = {
        "orders": table(spark, sf, "orders").withColumn("seen", F.when(F.col("o_orderkey") % 9 > 0, F.lit(True))),
        "lineitem": table(spark, sf, "lineitem").withColumn("l_id", F.concat_ws("-", "l_orderkey", "l_linenumber")),
        "supplier": table(spark, sf, "supplier").where(F.col("s_suppkey") % 4 > 0)}
    out = failing_samples(tables, FAILING, {"orders": ["o_orderkey"], "lineitem": ["l_id"]}, 5)
    return out.select("test_id", "table_name", "place", "row_key").distinct()


def _failing_sql() -> str:
    o, li = "SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM orders", "SELECT *, l_orderkey || '-' || l_linenumber AS k FROM lineitem"

    def few(bad: str) -> str:
        return f"SELECT v FROM ({bad}) ORDER BY md5(CAST(v AS VARCHAR)) LIMIT 5"

    part = few("SELECT l_partkey AS v FROM lineitem GROUP BY 1 HAVING count(*) > 1")
    order = few("SELECT l_orderkey AS v FROM lineitem GROUP BY 1 HAVING count(*) > 6")
    orphan = few("SELECT DISTINCT l_suppkey AS v FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 > 0)")
    bad = {
        "value_range:orders.o_totalprice": f"SELECT k FROM ({o}) WHERE o_totalprice < 1000 OR o_totalprice > 400000",
        "enum:orders.o_orderstatus": f"SELECT k FROM ({o}) WHERE o_orderstatus NOT IN ('F', 'O')",
        "row_rule:orders.None": f"SELECT k FROM ({o}) WHERE o_custkey % 10 = 3",
        "regex:orders.o_orderpriority": f"SELECT k FROM ({o}) WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')",
        "length:orders.o_orderpriority": f"SELECT k FROM ({o}) WHERE length(o_orderpriority) > 8",
        "null_rate:orders.seen": f"SELECT k FROM ({o}) WHERE o_orderkey % 9 = 0",
        "unique:lineitem.l_partkey": f"SELECT k FROM ({li}) WHERE l_partkey IN ({part})",
        "fk_cardinality:lineitem.l_orderkey": f"SELECT k FROM ({li}) WHERE l_orderkey IN ({order})",
        "fk_resolves:lineitem.l_suppkey": f"SELECT k FROM ({li}) WHERE l_suppkey IN ({orphan})",
        "cross_field:lineitem.l_shipdate": f"SELECT k FROM ({li}) JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate + INTERVAL 2 DAYS"}
    return " UNION ALL ".join(
        f"(SELECT DISTINCT * FROM (SELECT '{t}' AS test_id, '{t.split(':')[1].split('.')[0]}' AS table_name, "
        f"CAST(row_number() OVER (ORDER BY md5(k), k) AS INT) AS place, k AS row_key FROM ({q})) WHERE place <= 5)" for t, q in bad.items())


# --- answers that are easy to get wrong ---------------------------------------------------------

def _text_fk(spark: SparkSession, sf: str) -> DataFrame:
    """Text references to a numeric key: those that are no number do not resolve, and nothing stops."""
    child = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, F.lit("none")).when(
        F.col("o_orderkey") % 10 == 1, F.lit("-5")).otherwise(F.col("o_custkey").cast("string")).alias("customer"))
    out = run_tests({"c": child, "customer": table(spark, sf, "customer")}, [
        DataTest("fk_resolves", "c", "customer", {"ref_table": "customer", "ref_column": "c_custkey"})])
    return out.select("kind", "category", "passed", "bad_count")


TEXT_FK_SQL = """
SELECT 'fk_resolves' AS kind, 'referential' AS category, count(*) = 0 AS passed, count(*) AS bad_count FROM orders
WHERE o_orderkey % 10 IN (0, 1) OR o_custkey NOT IN (SELECT c_custkey FROM customer)"""


def _null_key_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Edits of rows whose key is NULL are applied like any other."""
    rows = table(spark, sf, "customer").select(F.when(F.col("c_custkey") != 1, F.col("c_custkey")).alias("k"), "c_custkey", "c_mktsegment", "c_nationkey")
    edits = table(spark, sf, "customer").where("c_custkey <= 20").select(
        F.when(F.col("c_custkey") != 1, F.col("c_custkey")).alias("k"), F.lit("c_mktsegment").alias("column"),
        F.concat(F.lit("edited "), "c_custkey").alias("value"))
    return apply_edits(rows, ["k"], edits)


NULL_KEY_EDITS_SQL = """
SELECT CASE WHEN c_custkey <> 1 THEN c_custkey END AS k, c_custkey,
       CASE WHEN c_custkey <= 20 THEN 'edited ' || c_custkey ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer"""


def _nan_range(spark: SparkSession, sf: str) -> DataFrame:
    """A suggested range over a column with NaN: bounds of the numbers, NaN in the reason."""
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("balance"))
    return suggest_rules(spark, {"customer": c}).select("kind", "reason", "min_value", "max_value")


NAN_RANGE_SQL = """
SELECT 'value_range' AS kind, 'observed ' || min(c_acctbal) FILTER (c_custkey % 9 > 0) || '..' || max(c_acctbal) FILTER (c_custkey % 9 > 0)
       || ', ' || count(*) FILTER (c_custkey % 9 = 0) || ' NaN' AS reason,
       CAST(min(c_acctbal) FILTER (c_custkey % 9 > 0) AS VARCHAR) AS min_value, CAST(max(c_acctbal) FILTER (c_custkey % 9 > 0) AS VARCHAR) AS max_value
FROM customer"""


QUERIES = {
    "profile_columns": _profile,
    "gen_quantile": _quantile,
    "gen_normal": _normal,
    "twin_observed": _twin,
    "fidelity_ks": _ks,
    "fidelity_empty_side": _empty_side,
    "diff_duplicate_keys": _diff,
    "failing_rows": _failing,
    "dt_fk_text": _text_fk,
    "edits_null_key": _null_key_edits,
    "profile_nan_range": _nan_range,
}
ORACLE = {
    "profile_columns": _profile_sql(),
    "gen_quantile": _quantile_sql(),
    "gen_normal": _normal_sql(),
    "twin_observed": _twin_sql(),
    "fidelity_ks": _ks_sql(),
    "fidelity_empty_side": EMPTY_SIDE_SQL,
    "diff_duplicate_keys": DIFF_SQL,
    "failing_rows": _failing_sql(),
    "dt_fk_text": TEXT_FK_SQL,
    "edits_null_key": NULL_KEY_EDITS_SQL,
    "profile_nan_range": NAN_RANGE_SQL,
}
