import random
import struct

import pytest

from ferrule.operators.covering import covering_rows, domains, generate_covering
from ferrule.operators.generate import generate_dataset
from ferrule.operators.paging import build_page_index, page_after, page_at
from ferrule.operators.pii import classify_columns, luhn_valid, mod97_valid
from ferrule.plans.spec import CycleError, SpecError, build_order, filled_later, parse_spec
from ferrule.sinks.files import row_numbers, sql_statements
from pyspark.sql import functions as F


def _key(name, kind="serial", **more):
    return {"name": name, "type": "bigint", "generator": {"kind": kind, "params": {}}, **more}


def test_covering_rows_hold_every_pair():
    r = random.Random(1)
    for _ in range(20):
        values = {f"c{i}": list(range(r.randrange(1, 7))) for i in range(r.randrange(1, 7))}
        rows = covering_rows(values)
        names = list(values)
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                assert {(x[a], x[b]) for x in rows} == {(x, y) for x in values[a] for y in values[b]}
            assert {x[a] for x in rows} == set(values[a])
        largest = sorted(map(len, values.values()))[-2:]
        assert len(rows) <= 2 * largest[0] * largest[-1] + 6  # near the least possible number
    assert covering_rows({}) == []


def test_generated_table_covers_and_keeps_its_rules(spark):
    t = parse_spec({"seed": 2, "tables": [{"name": "t", "row_count": 60, "primary_key": ["id"], "columns": [
        _key("id"), {"name": "s", "type": "text", "nullable": True, "null_rate": 0.5, "generator": {"kind": "categorical", "params": {"values": ["a", "b", "c"], "weights": [1, 0, 1]}}},
        {"name": "b", "type": "boolean", "generator": {"kind": "categorical", "params": {"values": [True, False]}}},
        {"name": "d", "type": "date", "generator": {"kind": "date_range", "params": {"low": "2024-01-01", "high": "2024-12-31"}}},
        {"name": "m", "type": "decimal(7,2)", "generator": {"kind": "decimal_range", "params": {"low": "-5.00", "high": "5.25", "scale": 2}}}]}]}).table("t")
    assert domains(t)["s"] == ["a", "c"]
    df = generate_covering(spark, t, 2)
    rows = df.collect()
    assert len(rows) == 60 == len({r.id for r in rows}) and [f.dataType for f in df.schema] == [c.type.spark_type() for c in t.columns]
    assert {(r.s, r.b) for r in rows} >= {(s, b) for s in "ac" for b in (True, False)}
    assert {(str(r.d), str(r.m)) for r in rows} >= {(d, m) for d in ("2024-01-01", "2024-12-31") for m in ("-5.00", "5.25")}
    with pytest.raises(SpecError):
        generate_covering(spark, t, 2, 2)


def _ring(nullable):
    return {"seed": 4, "tables": [
        {"name": a, "row_count": 40, "primary_key": ["id"], "columns": [_key("id"), _key("ref", "fk", nullable=a in nullable)],
         "foreign_keys": [{"column": "ref", "references_table": b, "references_column": "id", "min_per_parent": 1, "max_per_parent": 3}]}
        for a, b in (("x", "y"), ("y", "z"), ("z", "x"))]}


def test_cycles_are_broken_at_nullable_keys(spark, tmp_path):
    spec = parse_spec(_ring({"y"}))
    assert filled_later(spec) == {("y", "ref")} and build_order(spec) == ["y", "x", "z"]
    data = generate_dataset(spark, spec)
    for a, b in (("x", "y"), ("y", "z"), ("z", "x")):
        orphans = data[a].join(data[b].select(F.col("id").alias("k")), F.col("ref") == F.col("k"), "left_anti")
        assert data[a].count() > 0 and orphans.count() == 0
    stored = generate_dataset(spark, spec, materialize_dir=str(tmp_path))
    assert all(sorted(map(tuple, stored[n].collect())) == sorted(map(tuple, data[n].collect())) for n in data)
    with pytest.raises(CycleError):
        parse_spec(_ring(set()))


def test_rows_in_the_order_of_any_key(spark):
    r = random.Random(7)
    rows = [(r.choice([None, "", "a", "ä", "b\u0000", "Z"]), r.choice([0.0, -0.0, 1.5, float("nan"), None]), r.randrange(3)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, x double, n int").repartition(7)
    got = row_numbers(df, ["k", "n"], "i").orderBy("i").collect()

    def order(row):
        k, x, n = row
        number = (0, 0) if x is None else (2, 0) if x != x else (1, x)
        return (k is not None, (k or "").encode(), n, *number, x == 0 and struct.pack(">d", x)[0] > 127)

    bits = lambda x: None if x is None else "nan" if x != x else struct.pack(">d", x)
    assert [x.i for x in got] == list(range(4000))
    assert [(x.k, bits(x.x), x.n) for x in got] == [(k, bits(x), n) for k, x, n in sorted(rows, key=order)]
    assert sql_statements(df.where("n > 5"), "t", ["k"]).count() == 0
    text = sql_statements(df.where("x = 0 AND k = 'a'"), "t", ["k"], batch=10**6).first().statement
    assert text.count("-0.0") == sum(k == "a" and x is not None and x == 0 and bits(x)[0] > 127 for k, x, _ in rows)


def test_pages_by_index(spark, tmp_path):
    rows = [(i % 7 if i % 5 else None, i // 3, "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, v int, s string").repartition(5)
    build_page_index(df, ["k"], str(tmp_path / "p"))
    every = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for offset in (0, 3, 499, 990, 1000, 5000):
        page = page_at(spark, str(tmp_path / "p"), offset, 20).orderBy("row_no").collect()
        assert [tuple(x)[:3] for x in page] == every[offset:offset + 20]
    for at in (0, 137, 600, 999):
        key = dict(zip(("k", "v", "s"), every[at]))
        page = page_after(spark, str(tmp_path / "p"), key, 15).orderBy("row_no").collect()
        following = at + 1 + sum(x == every[at] for x in every[at + 1:])
        assert [tuple(x)[:3] for x in page] == every[following:following + 15]
    gone = page_after(spark, str(tmp_path / "p"), {"k": 3, "v": -1, "s": "x"}, 1).first()  # a row that is not there
    assert tuple(gone)[:3] == next(x for x in every if x[0] == 3)
    plan = page_at(spark, str(tmp_path / "p"), 500, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    build_page_index(df.where("v < 0"), ["k"], str(tmp_path / "none"))
    assert page_at(spark, str(tmp_path / "none"), 0, 5).count() == 0


def test_checks_of_numbers_and_classes(spark):
    df = spark.createDataFrame([("4539578763621486", "GB82WEST12345698765432"), ("4539578763621487", "GB82WEST12345698765433"), ("0", "DE89370400440532013000")], "c string, a string")
    got = df.select(luhn_valid(F.col("c")).alias("l"), mod97_valid(F.col("a")).alias("m")).collect()
    assert [(r.l, r.m) for r in got] == [(True, True), (False, False), (True, True)]
    t = spark.createDataFrame([("pay 4539-5787-6362-1486 now", "a@b.org"), ("pay 4539 5787 6362 1487", "c@d.org"), ("x4539578763621486", None)], "note string, mail string")
    rows = {(r.column_name, r.pii_kind): r for r in classify_columns(t, "t").collect()}
    card, mail = rows["note", "card_number"], rows["mail", "email"]
    assert (card.values, card.matching, card.valid, card.decision) == (3, 3, 1, "holds") and (mail.values, mail.rate, mail.decision) == (2, 1.0, "is")
    assert rows["mail", "iban"].decision == "no"
    empty = classify_columns(t.where("note = ''"), "t").first()
    assert empty.rate is None and empty.decision == "no" and classify_columns(spark.range(2), "t").count() == 0


def test_reject_rows_and_times(spark, tmp_path):
    from ferrule.sources.readers import cast_to_schema, read_jsonl, reject_rows
    df = spark.createDataFrame([(1, "5", "23:59"), (2, "x", "24:00"), (3, None, "12:30:61"), (4, "7.5", None), (5, "99999999999", "07:05:09.25")], "k int, n string, t string")
    declared = {"n": "integer", "t": "time"}
    got = {(r.k, r.column_name): (r.value, r.declared_type, r.reason) for r in reject_rows(df, declared, ["k"]).collect()}
    assert set(got) == {(2, "n"), (2, "t"), (3, "t"), (4, "n"), (5, "n")} and got[2, "t"] == ("24:00", "time", "cannot be read as TIME")
    cast, counts = cast_to_schema(df, declared)
    assert {r.column_name: r.rejected for r in counts.collect()} == {"n": 3, "t": 2}
    assert [r.t for r in cast.orderBy("k").collect()] == ["23:59", None, None, None, "07:05:09.25"]
    (tmp_path / "x.jsonl").write_text('{"t": "99:99"}\n')
    assert read_jsonl(spark, str(tmp_path), {"t": "time"}, strict=False).first().t is None
    with pytest.raises(Exception, match="not a time of day"):
        read_jsonl(spark, str(tmp_path), {"t": "time"}).collect()


def test_text_generators_refuse_what_they_ignore():
    for more in ({"locale": "de_DE"}, {"kwargs": {"nb": 3}}):
        with pytest.raises(SpecError, match="not supported"):
            parse_spec({"seed": 1, "tables": [{"name": "t", "row_count": 1, "columns": [
                {"name": "c", "type": "text", "generator": {"kind": "faker", "params": {"method": "name", **more}}}]}]})
