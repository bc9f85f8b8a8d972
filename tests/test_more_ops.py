import os
import tempfile

from pyspark.sql import functions as F

from conftest import GOLDEN
from ferrule.operators.compare import dataset_diff, pair_coverage, schema_drift, verbatim_leakage
from ferrule.operators.datatests import DataTest, run_tests, score_report
from ferrule.operators.discover import discover_fks, discover_keys
from ferrule.operators.edits import apply_edits
from ferrule.operators.empirical import empirical_column
from ferrule.operators.generate import generate_table, spine
from ferrule.operators.paging import page
from ferrule.operators.subset import consistent_subset
from ferrule.plans.spec import parse_spec
from ferrule.sources.readers import cast_to_schema, read_jsonl
from ferrule.streaming.chunks import generate_in_chunks, read_chunks


def test_chunked_generation_equals_whole(spark):
    t = parse_spec(GOLDEN).table("wells")
    path = os.path.join(tempfile.mkdtemp(), "chunks")
    dirs = generate_in_chunks(spark, t, 42, 230, 100, path)
    assert len(dirs) == 3
    again = generate_in_chunks(spark, t, 42, 230, 100, path)  # resumes: nothing rewritten
    assert again == dirs
    fewer = generate_in_chunks(spark, t, 42, 4, 10, path)  # asks for something else: nothing taken over
    assert read_chunks(spark, fewer).count() == 4
    whole = generate_table(spark, t, 42, n=230)
    back = read_chunks(spark, dirs).select(*whole.columns)
    assert back.exceptAll(whole).count() == 0 and whole.exceptAll(back).count() == 0


def test_keys_and_fks(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    child = spark.createDataFrame([(10, 1), (11, 1), (12, 3), (13, None)], "cid long, pid long")
    keys = {(r.table_name, r.column_name): r.is_key for r in
            discover_keys(spark, {"p": parent, "c": child}).collect()}
    assert keys[("p", "id")] and keys[("p", "name")] and keys[("c", "cid")] and not keys[("c", "pid")]
    fks = {(r.child_table, r.child_column, r.parent_table, r.parent_column): r.max_per_parent
           for r in discover_fks(spark, {"p": parent, "c": child}).collect()}
    assert fks[("c", "pid", "p", "id")] == 2


def test_jsonl_typed_and_casts(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "x.jsonl"), "w") as fh:
        fh.write('{"id":1,"day":"2024-06-01","at":"2026-07-04T10:00:00+02:00","amt":"12.30"}\n\n')
        fh.write('{"id":2,"day":null,"at":"2026-07-04T10:00:00","amt":1.5}\n')
    df = read_jsonl(spark, d, {"id": "bigint", "day": "date", "at": "timestamp",
                               "amt": "numeric(10,2)"}).orderBy("id")
    rows = df.collect()
    assert str(rows[0].at) == "2026-07-04 08:00:00" and str(rows[0].amt) == "12.30"
    assert rows[1].day is None and dict(df.dtypes)["at"] == "timestamp_ntz"
    raw = spark.createDataFrame([("1", "x"), ("2", "3")], "a string, b string")
    cast, rej = cast_to_schema(raw, {"a": "integer", "b": "integer"})
    assert {r.column_name: r.rejected for r in rej.collect()} == {"a": 0, "b": 1}


def test_cross_field_and_structure(spark):
    p = spark.createDataFrame([(1, 10), (2, 20)], "pk long, lim long")
    c = spark.createDataFrame([(1, 5, "ab1"), (1, 15, "zz"), (2, 25, "cd2"), (3, 1, None)],
                              "fk long, v long, code string")
    tests = [DataTest("cross_field", "c", "v", {"ref_table": "p", "on": [["fk", "pk"]], "expr": "v <= lim"}),
             DataTest("regex", "c", "code", {"pattern": "^[a-z]{2}[0-9]$"}),
             DataTest("length", "c", "code", {"min": 3, "max": 3}),
             DataTest("row_rule", "c", None, {"expr": "v > 0"})]
    r = {x.test_id: x.bad_count for x in run_tests({"p": p, "c": c}, tests).collect()}
    assert r == {"cross_field:c.v": 2, "regex:c.code": 1, "length:c.code": 1, "row_rule:c.None": 0}
    s = score_report(run_tests({"p": p, "c": c}, tests)).first()
    assert s.tests == 4 and s.passed == 1 and 0 < s.score < 1


def test_subset_is_consistent(spark):
    cust = spark.range(0, 200).select(F.col("id").alias("ck"), (F.col("id") % 5).alias("nk"))
    orders = spark.range(0, 1000).select(F.col("id").alias("ok"), (F.col("id") % 200).alias("ck"))
    nation = spark.range(0, 5).select(F.col("id").alias("nk"))
    sel = consistent_subset({"c": cust, "o": orders, "n": nation}, "c", "ck", 0.2, 7,
                            [("o", "ck", "c", "ck")], [("c", "nk", "n", "nk")])
    assert 0 < sel["c"].count() < 200
    assert sel["o"].join(sel["c"], "ck", "left_anti").count() == 0
    assert sel["c"].join(sel["n"], "nk", "left_anti").count() == 0


def test_diff_drift_leak_coverage(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, "z", 3.0)], "k long, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.5), (3, "z", 3.0), (4, "w", 4.0)], "k long, s string, v double")
    d = {r.column_name: (r.added, r.removed, r.changed) for r in dataset_diff(a, b, ["k"]).collect()}
    assert d["__rows__"] == (1, 1, 1) and d["v"] == (0, 0, 1) and d["s"] == (0, 0, 0)
    drift = {r.column_name: r.status for r in schema_drift(a, b.withColumn("v", F.col("v").cast("float"))
                                                           .withColumn("n", F.lit(1))).collect()}
    assert drift == {"k": "same", "s": "same", "v": "changed", "n": "added"}
    leak = verbatim_leakage(a, b, ["s"]).first()
    assert (leak.leaked_rows, leak.leaked_values) == (2, 2)
    cov = {(r.s, r.v): r.rows for r in pair_coverage(a, "s", ["x", "q"], "v", [1.0]).collect()}
    assert cov == {("x", 1.0): 1, ("q", 1.0): 0}


def test_edits_and_empirical_and_paging(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, s string, n int")
    edits = spark.createDataFrame([(2, "s", "B", 1), (2, "n", "21", 1), (2, "s", "BB", 2)],
                                  "k long, column string, value string, seq int")
    out = {r.k: (r.s, r.n) for r in apply_edits(df, ["k"], edits).collect()}
    assert out == {1: ("a", 10), 2: ("BB", 21)}
    src = spark.createDataFrame([("x",)] * 90 + [("y",)] * 10, "c string")
    gen = empirical_column(spine(spark, 20000), "__row", src, "c", 3, "t", "v")
    share = gen.agg(F.avg((F.col("v") == "x").cast("double"))).first()[0]
    assert abs(share - 0.9) < 0.02 and gen.count() == 20000
    pg = page(spark.range(0, 50).withColumnRenamed("id", "k"), ["k"], offset=45, limit=10).collect()
    assert [r.k for r in pg] == [45, 46, 47, 48, 49] and pg[0].total_rows == 50


def test_value_coverage_and_failing_rows(spark):
    from ferrule.operators.compare import value_coverage
    from ferrule.operators.datatests import failing_rows
    df = spark.createDataFrame([("a", 1), ("a", 50), ("b", 7)], "s string, n long")
    cov = {r.s: r.rows for r in value_coverage(df, "s", ["a", "b", "c"]).collect()}
    assert cov == {"a": 2, "b": 1, "c": 0}
    bad = failing_rows(df, DataTest("value_range", "t", "n", {"min": 0, "max": 10}), k=5).collect()
    assert [r.n for r in bad] == [50]


def test_draw_barrier_keeps_filters_small(spark):
    from ferrule.functions.draw import with_draws
    base = spark.range(0, 1000).withColumnRenamed("id", "k")
    plain = with_draws(base, "k", {"d": 99}).where(F.col("d") < 2 ** 31)
    fenced = with_draws(base, "k", {"d": 99}, barrier=True).where(F.col("d") < 2 ** 31)
    p_plain = plain._jdf.queryExecution().optimizedPlan().toString()
    p_fenced = fenced._jdf.queryExecution().optimizedPlan().toString()
    assert len(p_fenced) * 3 < len(p_plain)  # the filter no longer re-inlines every round
    assert plain.count() == fenced.count()
