import json
import tempfile
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ferrule.functions.render import float_text
from ferrule.plans.manifest import type_agreement
from ferrule.sinks.catalog import (ForeignNamespaceError, NamespaceExistsError, UnsafeNamespaceError,
                                   load_namespace, namespace_for, teardown, validate_namespace)
from ferrule.sinks.files import (copy_lines, export_tables, read_lines, sql_statements, write_csv,
                                 write_jsonl)


@pytest.fixture()
def f6(spark):
    return spark.createDataFrame(
        [(1, "Ann", Decimal("0.10"), True), (2, "O'Brien", Decimal("1000.00"), False),
         (3, None, Decimal("3.99"), True)],
        "id long, name string, balance decimal(12,2), active boolean")


def test_csv_and_jsonl(spark, f6):
    out = tempfile.mkdtemp()
    write_csv(f6, f"{out}/c.csv", ["id"])
    lines = read_lines(f"{out}/c.csv")
    assert lines[0] == '"id","name","balance","active"'
    assert lines[1:] == ['1,"Ann",0.10,true', '2,"O\'Brien",1000.00,false', '3,,3.99,true']
    write_jsonl(f6, f"{out}/j.jsonl", ["id"])
    rows = [json.loads(x) for x in read_lines(f"{out}/j.jsonl")]
    assert rows[0] == {"id": 1, "name": "Ann", "balance": "0.10", "active": True}
    assert rows[2]["name"] is None
    assert read_lines(f"{out}/j.jsonl")[0] == '{"id": 1, "name": "Ann", "balance": "0.10", "active": true}'


def test_sql_statements_batches(spark, f6):
    st = sql_statements(f6, "customers", ["id"], batch=2).orderBy("stmt_no").collect()
    assert len(st) == 2
    assert st[0].statement == ('INSERT INTO "customers" ("id", "name", "balance", "active") VALUES\n'
                               "  (1, 'Ann', 0.10, TRUE),\n  (2, 'O''Brien', 1000.00, FALSE);")
    assert "NULL" in st[1].statement


def test_copy_text(spark):
    df = spark.createDataFrame(
        [(7, "mira", False, Decimal("12.50"), float("-inf"), date(1999, 12, 31),
          datetime(2031, 2, 3, 4, 5, 6), bytearray(b"\x00\xff"), "one\\two\tthree\r"),
         (8, None, True, Decimal("-3.00"), float("nan"), None, None, None, "")],
        "id long, name string, ok boolean, amt decimal(10,2), f double, d date, ts timestamp_ntz, "
        "b binary, t string")
    lines = [r.line for r in copy_lines(df).orderBy("id").collect()]
    assert lines[0] == "7\tmira\tf\t12.50\t-Infinity\t1999-12-31\t2031-02-03 04:05:06\t\\\\x00ff\tone\\\\two\\tthree\\r"
    assert lines[1] == "8\t\\N\tt\t-3.00\tNaN\t\\N\t\\N\t\\N\t"
    tz = spark.createDataFrame([(datetime(2026, 7, 1, 13, 5, 9, tzinfo=timezone.utc),)], "ts timestamp")
    assert copy_lines(tz).first().line == "2026-07-01 13:05:09+00:00"
    nul = spark.createDataFrame([("a\x00b",)], "t string")
    with pytest.raises(Exception):
        copy_lines(nul).collect()


def test_float_text_matches_python(spark):
    vals = [1e7, 1e-5, 1e16, 0.1 + 0.2, 5e-4, -0.0, 123.0, 12345678.9, 2.5e-7, -2e20]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double")
           .select(float_text(F.col("x"))).collect()]
    assert got == [str(v) for v in vals]


def test_export_rejects(spark, f6):
    with pytest.raises(ValueError):
        export_tables({"t": f6}, tempfile.mkdtemp(), ["xml"], {})
    with pytest.raises(ValueError):
        export_tables({"../evil": f6}, tempfile.mkdtemp(), ["csv"], {})
    out = tempfile.mkdtemp()
    res = export_tables({"t": f6}, out, ["csv", "jsonl", "sql"], {"t": ["id"]})
    assert res["total_rows"] == 3
    again = tempfile.mkdtemp()
    export_tables({"t": f6}, again, ["csv"], {"t": ["id"]})
    assert read_lines(f"{out}/t.csv") == read_lines(f"{again}/t.csv")


def test_type_agreement_lies(spark):
    df = spark.createDataFrame([], "id long, amount decimal(10,2), name string, created timestamp, f double")
    cols = [{"name": "id", "canonical_kind": "INT64"},
            {"name": "amount", "canonical_kind": "DECIMAL", "precision": 10, "scale": 2},
            {"name": "name", "canonical_kind": "STRING"},
            {"name": "created", "canonical_kind": "TIMESTAMP", "tz": True}]
    assert all(r.ok for r in type_agreement("t", cols, df).collect())
    lies = [{"name": "f", "canonical_kind": "DECIMAL", "precision": 10, "scale": 2},
            {"name": "id", "canonical_kind": "INT32"},
            {"name": "created", "canonical_kind": "TIMESTAMP", "tz": False},
            {"name": "amount", "canonical_kind": "DECIMAL", "precision": 12, "scale": 2},
            {"name": "amount", "canonical_kind": "DECIMAL", "precision": 10},
            {"name": "gone", "canonical_kind": "STRING"}]
    probs = [r.problem for r in type_agreement("t", lies, df).collect()]
    assert probs == ["type", "type", "tz", "precision", "scale", "missing"]


def test_namespaces():
    for ok in ("ds_1", "ds_abc123", "ds_a_b_c", "ds_0"):
        assert validate_namespace(ok) == ok
    for bad in ("customers", "public", "pg_catalog", "information_schema", "sw_1", "ds_ABC", "ds_",
                "ds_a-b", "ds_x; DROP SCHEMA public", "ds_a b", "", "ds_" + "a" * 61):
        with pytest.raises(UnsafeNamespaceError):
            validate_namespace(bad)
    assert namespace_for("My Dataset!") != namespace_for("my dataset")
    assert validate_namespace(namespace_for("x" * 200))


def test_load_replace_teardown(spark):
    df = spark.createDataFrame([(1, "a@x.io", Decimal("1.00")), (2, "b@x.io", Decimal("2.50")),
                                (3, None, Decimal("3.99"))], "id long, email string, balance decimal(12,2)")
    ns = "ds_test_load"
    teardown(spark, ns)
    assert teardown(spark, ns)["existed"] is False
    load_namespace(spark, ns, {"customers": df})
    with pytest.raises(NamespaceExistsError):
        load_namespace(spark, ns, {"customers": df})
    load_namespace(spark, ns, {"customers": df}, mode="replace")
    load_namespace(spark, ns, {"customers": df}, mode="replace")
    assert spark.table(f"{ns}.customers").count() == 3
    spark.sql("CREATE DATABASE IF NOT EXISTS ds_foreign")
    with pytest.raises(ForeignNamespaceError):
        teardown(spark, "ds_foreign")
    with pytest.raises(ForeignNamespaceError):
        load_namespace(spark, "ds_foreign", {"customers": df}, mode="replace")
    assert teardown(spark, ns)["dropped"] is True


def test_sql_statements_with_hot_copies(spark):
    # one row repeated many times plus a duplicated key: numbering stays dense and complete
    rows = [(1, "a")] * 1200 + [(2, "b"), (2, "c"), (3, None)]
    df = spark.createDataFrame(rows, "k long, s string")
    st = sql_statements(df, "t", ["k"], batch=500).collect()
    body = "".join(r.statement for r in st)
    assert len(st) == 3 and body.count("(1, 'a')") == 1200 and body.count("(3, NULL)") == 1


def test_jdbc_dialect_types_and_embedded_load(spark):
    from ferrule.sinks.jdbc import column_type, count_rows, create_table_ddl, load_jdbc
    cols = [{"name": "id", "canonical_kind": "INT64", "nullable": False},
            {"name": "ok", "canonical_kind": "BOOLEAN"},
            {"name": "amt", "canonical_kind": "DECIMAL", "precision": 12, "scale": 2},
            {"name": "at", "canonical_kind": "TIMESTAMP", "tz": True},
            {"name": "doc", "canonical_kind": "JSON"}]
    assert column_type("postgresql", cols[3]) == "TIMESTAMP WITH TIME ZONE"
    assert column_type("db2", cols[3]) == "TIMESTAMP" and column_type("db2", cols[1]) == "SMALLINT"
    assert column_type("postgresql", cols[4]) == "JSONB" and column_type("h2", cols[4]) == "CLOB"
    assert column_type("ansi", {"canonical_kind": "STRING", "length": 40000}) == "CLOB"
    assert create_table_ddl("postgresql", "t", cols[:1]) == 'CREATE TABLE "t" ("id" BIGINT NOT NULL)'
    # embedded in-process Derby (no server): ANSI dialect → booleans 1/0, UTC wall time
    from datetime import datetime, timezone
    df = spark.createDataFrame(
        [(1, True, Decimal("1.00"), datetime(2026, 7, 4, 10, 0, tzinfo=timezone.utc), '{"a":1}'),
         (2, False, Decimal("2.50"), None, None)],
        "id long, ok boolean, amt decimal(12,2), at timestamp, doc string")
    url = "jdbc:derby:memory:ferrule_t;create=true"
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    load_jdbc(spark, df, url, "T1", cols, props)
    assert count_rows(spark, url, "T1", props) == 2
    back = spark.read.jdbc(url, '"T1"', properties=props).orderBy("id").collect()
    assert back[0]["ok"] == 1 and str(back[0]["at"]) == "2026-07-04 10:00:00"
