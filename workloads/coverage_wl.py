"""Jobs that need an order or a second pass: covering arrays, cycles between tables, SQL in the order of any
key, pages by index, and classes of columns by checked matches.  The oracle SQL stands on its own."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.covering import covering_rows, domains, generate_covering
from ferrule.operators.generate import generate_dataset
from ferrule.operators.paging import build_page_index, page_after, page_at
from ferrule.operators.pii import classify_columns
from ferrule.plans.spec import parse_spec
from ferrule.session import scratch_path
from ferrule.sinks.catalog import LoadVerificationError, load_namespace, namespace_for, teardown
from ferrule.sinks.files import sql_statements
from ferrule.sources.readers import reject_rows

from .common import table
from .distribution_wl import SEED, _draws, _seed_of

# --- generation towards coverage (X11) ----------------------------------------------------------

LISTED = {"priority": ("orders", "o_orderpriority"), "status": ("orders", "o_orderstatus"), "segment": ("customer", "c_mktsegment"),
          "flag": ("lineitem", "l_returnflag"), "mode": ("part", "p_brand")}


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of values that orders, customers, lines and parts hold, and whether a table generated in as few
    rows as cover them has it; the customer keys' ends stand for their range."""
    columns = [{"name": "id", "type": "bigint", "generator": {"kind": "serial", "params": {}}, "unique": True}]
    for name, (t, c) in LISTED.items():  # the declared lists: distinct values of short code columns
        values = sorted(r[0] for r in table(spark, sf, t).select(c).where(F.col(c).isNotNull()).distinct().collect())
        columns.append({"name": name, "type": "text", "generator": {"kind": "categorical", "params": {"values": values}}})
    ends = table(spark, sf, "orders").agg(F.min("o_custkey"), F.max("o_custkey")).first()
    columns.append({"name": "customer", "type": "bigint", "generator": {"kind": "int_range", "params": {"low": ends[0], "high": ends[1]}}})
    t = parse_spec({"seed": SEED, "tables": [{"name": "covered", "row_count": 1, "primary_key": ["id"], "columns": columns}]}).table("covered")
    declared = domains(t)
    made = generate_covering(spark, t, SEED, len(covering_rows(declared)))
    pairs = list(combinations([*LISTED, "customer"], 2))
    there = made.select(F.explode(F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(a).cast("string").alias("value_a"),
                                                     F.col(b).cast("string").alias("value_b")) for a, b in pairs])).alias("p")).select("p.*").distinct()
    wanted = spark.createDataFrame([(a, b, str(x), str(y)) for a, b in pairs for x in declared[a] for y in declared[b]], there.schema)
    return wanted.join(there.withColumn("covered", F.lit(True)), there.columns, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def _coverage_sql() -> str:
    lists = [f"SELECT DISTINCT '{n}' AS c, {k} AS p, {c} AS v FROM {t} WHERE {c} IS NOT NULL" for k, (n, (t, c)) in enumerate(LISTED.items())]
    lists.append("SELECT 'customer', 5, unnest([CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR)]) FROM orders")
    return (f"WITH d AS ({' UNION ALL '.join(lists)}) SELECT a.c AS column_a, b.c AS column_b, a.v AS value_a, b.v AS value_b, "
            "TRUE AS covered FROM d a JOIN d b ON a.p < b.p")


# --- cycles between tables (X13, G20) -----------------------------------------------------------

CYCLE = {"seed": SEED, "tables": [
    {"name": "teams", "row_count": 1, "primary_key": ["id"],
     "foreign_keys": [{"column": "head_id", "references_table": "people", "references_column": "id", "max_per_parent": 9}],
     "columns": [{"name": "id", "type": "bigint", "generator": {"kind": "serial", "params": {}}},
                 {"name": "head_id", "type": "bigint", "nullable": True, "generator": {"kind": "fk", "params": {}}}]},
    {"name": "people", "row_count": None, "primary_key": ["id"],
     "foreign_keys": [{"column": "team_id", "references_table": "teams", "references_column": "id", "min_per_parent": 1, "max_per_parent": 5}],
     "columns": [{"name": "id", "type": "bigint", "generator": {"kind": "serial", "params": {}}},
                 {"name": "team_id", "type": "bigint", "generator": {"kind": "fk", "params": {}}}]}]}


def _cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Teams (one for every customer) and their people, each team with a head among all people: keys and the head's
    team."""
    n = table(spark, sf, "customer").count()
    data = generate_dataset(spark, parse_spec(CYCLE), {"teams": n})
    head = data["people"].select(F.col("id").alias("head_id"), F.col("team_id").alias("head_team"))
    size = data["people"].groupBy(F.col("team_id").alias("id")).agg(F.count(F.lit(1)).alias("people"))
    return data["teams"].join(head, "head_id", "left").join(size, "id", "left")


def _cycle_sql() -> str:
    seeds = {"k": _seed_of("people", "__cardinality__", "team_id"), "d0": _seed_of("teams", "__fk_sample__", "head_id"),
             "d1": _seed_of("teams", "__fk_sample__", "head_id", "__draw1__")}
    return (
        f"WITH d AS ({_draws('SELECT range AS i FROM range((SELECT count(*) FROM customer))', 'i', seeds, 'i')}), "
        "t AS (SELECT i, 1 + k % 5 AS n, (d0 << 31) | (d1 >> 1) AS u FROM d), "
        "p AS (SELECT i, n, u, CAST(sum(n) OVER (ORDER BY i) AS BIGINT) AS upto, CAST(sum(n) OVER () AS BIGINT) AS m FROM t), "
        "h AS (SELECT i + 1 AS id, n AS people, u % m + 1 AS head_id FROM p) "
        "SELECT h.id, people, head_id, p.i + 1 AS head_team FROM h JOIN p ON head_id > upto - n AND head_id <= upto")


# --- SQL text in the order of any key (S04, S13) ------------------------------------------------

def _sql_text_key(spark: SparkSession, sf: str) -> DataFrame:
    """INSERT statements of a table without a key, in the order of a text column with NULLs and repeats; -0.0 stays."""
    zero = F.when(F.col("c_custkey") % 10 == 0, F.lit(-0.0)).when(F.col("c_custkey") % 5 == 0, F.lit(0.0))
    rows = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 11 > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"),
        F.coalesce(zero, (F.col("c_custkey") % 7).cast("double")).alias("score"))
    return sql_statements(rows.unionAll(rows), "scores", ["segment"])


SQL_TEXT_KEY_SQL = """
WITH r AS (SELECT CASE WHEN c_custkey % 11 > 0 THEN c_mktsegment END AS segment, c_nationkey AS nation,
                  CASE WHEN c_custkey % 10 = 0 THEN '-0.0'::DOUBLE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_custkey % 7 END::DOUBLE AS score
           FROM customer),
t AS (SELECT * FROM r UNION ALL SELECT * FROM r),
n AS (SELECT *, row_number() OVER (ORDER BY segment NULLS FIRST, nation NULLS FIRST, score, CAST(score AS VARCHAR) = '-0.0') - 1 AS i FROM t)
SELECT i // 500 AS stmt_no, 'INSERT INTO "scores" ("segment", "nation", "score") VALUES' || chr(10) ||
       string_agg('  (' || coalesce('''' || segment || '''', 'NULL') || ', ' || nation || ', ' || CAST(score AS VARCHAR) || ')', ',' || chr(10) ORDER BY i)
       || ';' AS statement FROM n GROUP BY 1"""


# --- pages by index (R02) -----------------------------------------------------------------------

def _page_after(spark: SparkSession, sf: str) -> DataFrame:
    """The page in the middle of the lines by ship date (a key that repeats), and the page after its last row."""
    rows = table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    path = scratch_path(spark, f"pages-{uuid.uuid4().hex[:12]}")
    build_page_index(rows, ["l_shipdate"], path)
    first = page_at(spark, path, rows.count() // 2, 100)
    last = first.orderBy(F.desc("row_no")).first()
    parts = [first.withColumn("page", F.lit(1)), page_after(spark, path, last.asDict(), 100).withColumn("page", F.lit(2))]
    return reduce(DataFrame.unionByName, parts)


PAGE_AFTER_SQL = """
WITH n AS (SELECT l_shipdate, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS row_no,
                  count(*) OVER () // 2 AS mid FROM lineitem)
SELECT l_shipdate, l_orderkey, l_linenumber, row_no, CAST(1 + (row_no - mid) // 100 AS INT) AS page FROM n WHERE row_no >= mid AND row_no < mid + 200"""


# --- classes of columns (X15) -------------------------------------------------------------------

def _pii_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of personal data by column: whole documents, events' properties, and card and account numbers made from
    customers' keys, some of which pass their checks."""
    key = F.col("c_custkey")
    numbers = table(spark, sf, "customer").select(
        F.concat(F.lit("4000-00"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((key % 9973).cast("string"), 4, "0"),
                 F.lit("-"), F.lpad((key * 7 % 10000).cast("string"), 4, "0")).alias("card"),
        F.concat(F.lit("payee DE"), F.lpad((key % 100).cast("string"), 2, "0"), F.lpad((key * 31).cast("string"), 18, "0"), F.lit(".")).alias("account"),
        F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", ".")), F.lit("@example.org")).alias("mail"))
    parts = [classify_columns(table(spark, sf, "documents").select("text", "source"), "documents"),
             classify_columns(table(spark, sf, "events").select("props"), "events"), classify_columns(numbers, "numbers")]
    return reduce(DataFrame.unionByName, parts).withColumn("rate", F.round("rate", 9))


def _pii_classes_sql() -> str:
    kinds = {  # the patterns stated again
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        "phone": r"(^|[^0-9])\+?[0-9]{1,3}[-. ]?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}([^0-9]|$)",
        "card_number": r"(^|[^0-9])([0-9]{4}[- ]?){3}[0-9]{4}([^0-9]|$)",
        "ssn": r"(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9]|$)",
        "ipv4": r"(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}([^0-9.]|$)",
        "url": r"https?://[^\s]+", "secret": r"(?i)(api[_-]?key|secret|password|passwd|token)\s*[:=]",
        "iban": r"(^|[^0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}([^0-9A-Za-z]|$)"}
    luhn = ("list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(x), i, 1) AS INT) "
            "ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse(x), i, 1) AS INT) + 1] END)) % 10 = 0")
    iban = ("CAST(array_to_string(list_transform(string_split(substr(x, 5) || substr(x, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c "
            "ELSE CAST(ord(c) - 55 AS VARCHAR) END), '') AS HUGEINT) % 97 = 1")
    alone = "regexp_extract_all(v, '(?:^|[^0-9A-Za-z])({0})(?:[^0-9A-Za-z]|$)', 1)"
    valid = {"card_number": f"len(list_filter(list_transform({alone.format('(?:[0-9]{4}[- ]?){3}[0-9]{4}')}, lambda x: translate(x, '- ', '')), lambda x: {luhn})) > 0",
             "iban": f"len(list_filter({alone.format('[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}')}, lambda x: {iban})) > 0"}
    numbers = ("SELECT '4000-00' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 9973 AS VARCHAR), 4, '0') || '-' || "
               "lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0') AS card, 'payee DE' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || "
               "lpad(CAST(c_custkey * 31 AS VARCHAR), 18, '0') || '.' AS account, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')) || '@example.org' AS mail FROM customer")
    columns = [("documents", "text", "documents"), ("documents", "source", "documents"), ("events", "props", "events"),
               *[("numbers", c, f"({numbers})") for c in ("card", "account", "mail")]]
    parts = []
    for t, c, source in columns:
        for kind, pattern in kinds.items():
            hit = f"regexp_matches(v, '{pattern}')"
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS pii_kind, count(v) AS values, "
                         f"count(*) FILTER ({hit}) AS matching, count(*) FILTER ({valid.get(kind, hit)}) AS valid FROM (SELECT {c} AS v FROM {source})")
    return ("SELECT *, round(valid::DOUBLE / nullif(values, 0), 9) AS rate, CASE WHEN valid >= 0.8 * values AND values > 0 THEN 'is' "
            f"WHEN valid >= 0.01 * values AND values > 0 THEN 'holds' ELSE 'no' END AS decision FROM ({' UNION ALL '.join(parts)})")


# --- typed columns and their rejects (G29) ------------------------------------------------------

DECLARED = {"customer": "integer", "day": "date", "at": "time", "price": "numeric(12,2)"}


def _reject_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text, some of which is no integer, no date or no time of day: every rejected value."""
    k = F.col("o_orderkey")
    text = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 13 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(k % 17 == 0, "2024-02-30").when(k % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.concat(F.lpad((k % 26).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 63).cast("string"), 2, "0")).alias("at"),
        F.round("o_totalprice", 2).cast("decimal(12,2)").cast("string").alias("price"))
    return reject_rows(text, DECLARED, ["o_orderkey"])


REJECT_ROWS_SQL = """
WITH t AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 26 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 63 AS VARCHAR), 2, '0') AS tod FROM orders)
SELECT o_orderkey, 'customer' AS column_name, 'integer' AS declared_type, 'n/a' AS value, 'cannot be read as INT32' AS reason FROM t WHERE o_orderkey % 13 = 0
UNION ALL SELECT o_orderkey, 'day', 'date', '2024-02-30', 'cannot be read as DATE' FROM t WHERE o_orderkey % 17 = 0
UNION ALL SELECT o_orderkey, 'at', 'time', tod, 'cannot be read as TIME' FROM t WHERE o_orderkey % 26 > 23 OR o_orderkey % 63 > 59"""


# --- namespaces (S08, S09, S10) -----------------------------------------------------------------

def _namespace(spark: SparkSession, sf: str) -> DataFrame:
    """Rows a namespace holds after a load, after a replacement that must fail and leaves it alone, after one that
    succeeds, and whether it is gone at the end."""
    name = namespace_for(f"query {uuid.uuid4().hex[:12]}")
    customers, nations = table(spark, sf, "customer"), table(spark, sf, "nation")
    seen: list[tuple[str, str, int]] = []

    def look(step: str) -> None:
        for t in sorted(x.name for x in spark.catalog.listTables(name)):
            seen.append((step, t, spark.table(f"`{name}`.`{t}`").count()))

    try:
        load_namespace(spark, name, {"customer": customers, "nation": nations})
        look("loaded")
        try:
            load_namespace(spark, name, {"customer": customers}, mode="replace", expected={"customer": -1})
        except LoadVerificationError:
            look("refused")
        load_namespace(spark, name, {"customer": customers.where("c_custkey % 3 = 0"), "part": table(spark, sf, "part")}, mode="replace")
        look("replaced")
    finally:
        teardown(spark, name)
    seen.append(("gone", "", int(not spark.catalog.databaseExists(name))))
    return spark.createDataFrame(seen, "step string, table_name string, rows long")


NAMESPACE_SQL = """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS k FROM customer), t AS (SELECT count(*) AS n FROM nation),
p AS (SELECT count(*) AS n FROM part)
SELECT step, 'customer' AS table_name, n AS rows FROM c, (SELECT unnest(['loaded', 'refused']) AS step)
UNION ALL SELECT step, 'nation', n FROM t, (SELECT unnest(['loaded', 'refused']) AS step)
UNION ALL SELECT 'replaced', 'customer', k FROM c UNION ALL SELECT 'replaced', 'part', n FROM p UNION ALL SELECT 'gone', '', 1"""


QUERIES = {
    "gen_coverage": _coverage,
    "gen_cycle": _cycle,
    "render_sql_text_key": _sql_text_key,
    "page_after": _page_after,
    "pii_classes": _pii_classes,
    "cast_reject_rows": _reject_rows,
    "namespace_load": _namespace,
}
ORACLE = {
    "gen_coverage": _coverage_sql(),
    "gen_cycle": _cycle_sql(),
    "render_sql_text_key": SQL_TEXT_KEY_SQL,
    "page_after": PAGE_AFTER_SQL,
    "pii_classes": _pii_classes_sql(),
    "cast_reject_rows": REJECT_ROWS_SQL,
    "namespace_load": NAMESPACE_SQL,
}
