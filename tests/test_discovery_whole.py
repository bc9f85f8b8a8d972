"""Discovery and PII scans over all tables and column types."""

from conftest import SF001

from ferrule.operators.discover import all_column_stats, discover_fks, discover_keys
from workloads import discover_wl, xops_wl


def test_no_estimate_decides_a_key(spark):
    tables = {"t": spark.range(30_000).selectExpr("id", "id div 2 AS half", "cast(id AS double) AS x",
                                                  "if(id = 29999, 5, id * 3) AS late")}
    stats = all_column_stats(tables)
    for s in stats["t"]["columns"].values():
        s["approx"] = 1
    keys = {r.column_name: r.is_key for r in discover_keys(spark, tables, stats).collect()}
    assert keys == {"id": True, "half": False, "x": True, "late": True}
    tables["t"] = tables["t"].selectExpr("if(id = 29999, 3, id) AS late")  # repeated in the last row alone
    assert [r.is_key for r in discover_keys(spark, tables).collect()] == [False]


def test_fks_of_dates_and_decimals(spark):
    parent = spark.sql("SELECT date_add(DATE'2024-01-01', cast(id AS int)) AS day, cast(id * 100 AS decimal(9,1)) AS d, "
                       "timestamp_seconds(id) AS ts FROM range(40)")
    child = spark.sql("SELECT date_add(DATE'2024-01-01', cast(id % 9 AS int)) AS cday, cast(id % 7 * 100 AS decimal(12,3)) AS cd, "
                      "timestamp_seconds(id % 5) AS cts FROM range(30)")
    got = {(r.child_column, r.parent_column): r.max_per_parent for r in discover_fks(spark, {"p": parent, "c": child}).collect()}
    assert got == {("cday", "day"): 4, ("cd", "d"): 5, ("cts", "ts"): 6}


def test_registered_jobs_read_lineitem_and_all_text(spark):
    fks = {(r.child_column, r.parent_column) for r in discover_wl.QUERIES["discover_fks"](spark, SF001).collect()}
    assert {("l_orderkey", "o_orderkey"), ("l_partkey", "p_partkey"), ("l_suppkey", "s_suppkey")} <= fks
    keys = {r.column_name: r.is_key for r in discover_wl.QUERIES["discover_keys"](spark, SF001).collect()}
    assert keys["o_orderkey"] and keys["l_orderkey"] is False and "l_shipdate" in keys
    scanned = {(r.table_name, r.column_name) for r in xops_wl.QUERIES["pii_scan"](spark, SF001).collect()}
    assert {("pages", "html"), ("benchmark", "text"), ("events", "props"), ("documents", "text")} <= scanned
