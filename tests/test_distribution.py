import math
import random
import statistics
from decimal import Decimal

import pytest

from ferrule.operators.compare import category_fidelity, dataset_diff, numeric_fidelity
from ferrule.operators.datatests import DataTest, failing_samples, run_tests
from ferrule.operators.distribution import exact_profile, running_totals, two_sample_distance
from ferrule.operators.edits import apply_edits, unapplied_edits
from ferrule.operators.empirical import quantile_column
from ferrule.operators.generate import generate_dataset, generate_table
from ferrule.operators.profile import suggest_rules
from ferrule.operators.twin import make_twin
from ferrule.plans.spec import SpecError, parse_spec, spec_to_dict


def test_running_totals_of_a_group_over_many_ranges(spark):
    rows = [("hot" if i % 3 else None, i, 1 + i % 5) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    out = running_totals(spark.createDataFrame(rows, "g string, i int, w long"), ["g"], ["i"], {"before": "w"}).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, sums = {}, {}
    for g, i, w in rows:
        want[g, i] = sums.get(g, 0)
        sums[g] = want[g, i] + w
    assert {(r.g, r.i): r.before for r in out} == want


def test_exact_profile(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'b', 1.5D, DATE'2024-01-02', true, 1.25BD, array(1)), (2, 'a', double('NaN'), NULL, false, -3.5BD, NULL),
                      (2, 'a', -0.0D, DATE'2024-01-01', true, 1.25BD, NULL), (NULL, '', 0.0D, NULL, NULL, NULL, NULL) AS t(i, s, d, day, b, m, arr)""")
    got = {r.column_name: r for r in exact_profile(df, 2).collect()}
    assert (got["i"].distinct_values, got["i"].nulls, got["i"].quartiles, got["i"].min_value) == (2, 1, [1.0, 2.0, 2.0], "1")
    assert [tuple(x) for x in got["s"].top_values] == [("a", 2), ("", 1)] and got["s"].quartiles is None
    assert got["d"].distinct_values == 3 and got["d"].max_value == "NaN" and got["d"].quartiles == [0.0, 0.0, 1.5]
    assert (got["day"].min_value, got["day"].null_rate, got["b"].max_value, got["m"].min_value) == ("2024-01-01", 0.5, "true", "-3.50")
    assert got["arr"].nulls == 3 and got["arr"].distinct_values is None
    empty = exact_profile(df.where("i > 9")).collect()
    assert len(empty) == 7 and all(r.rows == 0 and r.null_rate is None and r.min_value is None for r in empty)


def test_two_sample_distance(spark):
    r = random.Random(1)
    a, b = [r.gauss(0, 1) for _ in range(700)], [r.gauss(0.3, 1) for _ in range(900)]
    sides = [spark.createDataFrame([(x, None) for x in v] + [(None, None)] * k, "x double, z int") for v, k in ((a, 100), (b, 0))]
    got = {x.column_name: x for x in two_sample_distance(*sides, ["x", "z"]).collect()}
    want = max(abs(sum(x <= t for x in a) / len(a) - sum(x <= t for x in b) / len(b)) for t in a + b)
    assert got["x"].ks == pytest.approx(want, abs=1e-12) and got["x"].null_gap == pytest.approx(1 / 8)
    assert got["z"].ks == 0 and got["z"].distinct_gap == 0 and got["z"].null_gap == 0
    one = two_sample_distance(sides[0], sides[0].where("x > 99"), ["x"]).first()
    assert one.ks == 1 and one.null_rate_other is None and one.null_gap is None


def test_distances_of_empty_sides(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "c string, n double")
    none = spark.createDataFrame([(None, None)], "c string, n double")
    for x, y, want in ((a, none, 1), (none, a, 1), (none, none, 0), (a, a, 0)):
        assert category_fidelity(x, y, "c").first().tvd == want
        assert numeric_fidelity(x, y, "n").first().tvd == want == numeric_fidelity(x, y, "n").first().ks


def test_normal_moments_and_tails(spark):
    spec = parse_spec({"seed": 5, "tables": [{"name": "t", "row_count": 1_000_000, "columns": [
        {"name": "v", "type": "decimal(12,3)", "generator": {"kind": "normal", "params": {"mean": -20, "std": 4}}},
        {"name": "k", "type": "integer", "generator": {"kind": "normal", "params": {"mean": 0, "std": 3, "low": -5, "high": 5}}}]}]})
    row = generate_table(spark, spec.table("t"), 5).selectExpr(
        "avg(v) m", "stddev(v) s", "skewness(cast(v as double)) sk", "kurtosis(cast(v as double)) ku", "min(k) lo", "max(k) hi",
        "percentile(v, array(0.001, 0.025, 0.5, 0.975, 0.999)) q", "min(v) < -38 far").first()
    assert abs(float(row.m) + 20) < 0.02 and abs(float(row.s) - 4) < 0.01 and abs(row.sk) < 0.01 and abs(row.ku) < 0.02
    normal = statistics.NormalDist(-20, 4)
    assert all(abs(q - normal.inv_cdf(p)) < 0.1 for q, p in zip(row.q, (0.001, 0.025, 0.5, 0.975, 0.999)))
    assert (row.lo, row.hi, row.far) == (-5, 5, True)
    with pytest.raises(SpecError):
        parse_spec({"seed": 1, "tables": [{"name": "t", "row_count": 1, "columns": [
            {"name": "v", "type": "integer", "generator": {"kind": "normal", "params": {"mean": 0, "std": -1}}}]}]})


def test_quantiles_of_the_inverse_distribution(spark):
    source = spark.createDataFrame([(float(x * x),) for x in range(200)] + [(100.0,)] * 50 + [(float("nan"),), (None,)], "v double")
    rows = quantile_column(spark.range(1_000_000), "id", source, "v", 3, "t", "out")
    probe = [0.1, 0.3, 0.5, 0.7, 0.9]
    got = rows.selectExpr(f"percentile(out, array({', '.join(map(str, probe))})) q", "count(*) n", "count(out) m", "count(distinct out) d").first()
    values = sorted([x * x for x in range(200)] + [100] * 50)
    steps, at = [], 0
    for v in sorted(set(values)):
        n = values.count(v)
        steps.append((at / 250, (at + n) / 250, v))
        at += n
    for p, q in zip(probe, got.q):
        lo, hi, v = next(s for s in steps if s[0] <= p < s[1])
        nxt = min(x for x in values if x > v)
        assert q == pytest.approx(v + (nxt - v) * (p - lo) / (hi - lo), rel=0.02, abs=3)
    assert got.n == got.m == 1_000_000 and got.d > 500_000
    none = quantile_column(spark.range(3), "id", source.where("v < 0"), "v", 3, "t", "out")
    assert [r.out for r in none.collect()] == [None] * 3


def test_twin_follows_a_hot_parent_and_nulls(spark, tmp_path):
    parents = spark.range(1, 501).withColumnRenamed("id", "pk")
    children = spark.range(20_000).selectExpr("id AS ck", "CASE WHEN id % 3 = 0 THEN 7 ELSE 1 + id % 400 END AS pk", "CASE WHEN id % 5 > 0 THEN 'x' || id % 2 END AS s")
    keys = {"p": ["pk"], "c": ["ck"]}
    fks = {"c": [{"column": "pk", "references_table": "p", "references_column": "pk"}]}
    twin = make_twin(spark, {"p": parents, "c": children}, keys, fks, observed=True)
    per = twin.data["c"].groupBy("pk").count().groupBy("count").count().collect()
    source = children.groupBy("pk").count().groupBy("count").count().collect()
    assert sorted(map(tuple, per)) == sorted(map(tuple, source)) and twin.data["c"].count() == 20_000
    assert abs(twin.data["c"].where("s IS NULL").count() / 20_000 - 0.2) < 0.02
    assert twin.report().where("NOT passed").count() == 0
    assert parse_spec(spec_to_dict(parse_spec(twin.spec_json))).table("c").foreign_keys[0].child_counts
    double = {**twin.spec_json, "tables": [{**t, "row_count": 1000} if t["name"] == "p" else t for t in twin.spec_json["tables"]]}
    assert generate_dataset(spark, parse_spec(double))["c"].count() == 40_000  # in proportion
    with pytest.raises(SpecError):
        bad = {**twin.spec_json, "tables": [{**t, "foreign_keys": [{**f, "child_counts": [[10**9, 1]]} for f in t["foreign_keys"]]} for t in twin.spec_json["tables"]]}
        parse_spec(bad)


def test_diff_pairs_repeated_keys(spark):
    schema = "k int, a string, b int"
    a = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (1, "y", 2), (None, "n", 0), (None, "n", 0), (2, "z", None)], schema)
    b = spark.createDataFrame([(1, "y", 2), (1, "x", 1), (1, "q", 1), (None, "n", 0), (3, "w", 5), (2, "z", 4)], schema)
    assert all((r.added, r.removed, r.changed) == (0, 0, 0) for r in dataset_diff(a, a, ["k"]).collect())
    got = {r.column_name: (r.added, r.removed, r.changed) for r in dataset_diff(a, b, ["k"]).collect()}
    assert got == {"__rows__": (1, 1, 2), "a": (0, 0, 1), "b": (0, 0, 1)}
    many = spark.range(5000).selectExpr("1 AS k", "id AS v")  # one key, all rows differ
    assert dataset_diff(many, many.selectExpr("k", "v + 100000 AS v"), ["k"]).first().changed == 5000


def test_failing_samples_of_every_kind(spark):
    t = spark.createDataFrame([(i, "12" if i % 2 else "abc", float("nan") if i == 4 else float(i), i // 2, None if i == 5 else "v") for i in range(12)],
                              "id int, txt string, num double, ref int, n string")
    p = spark.createDataFrame([(0, 3), (1, 0), (2, 0), (3, 0)], "key int, low int")
    tests = [DataTest("value_range", "t", "txt", {"min": 0, "max": 50}), DataTest("value_range", "t", "num", {"min": 2}),
             DataTest("enum", "t", "n", {"values": [None]}), DataTest("null_rate", "t", "n", {"max": 0}), DataTest("unique", "t", "ref", {}),
             DataTest("fk_resolves", "t", "ref", {"ref_table": "p", "ref_column": "key"}), DataTest("fk_cardinality", "t", "ref", {"max_per_parent": 1}),
             DataTest("cross_field", "t", "id", {"ref_table": "p", "on": [["ref", "key"]], "expr": "id >= low"}), DataTest("length", "t", "txt", {"min": 3}),
             DataTest("fk_resolves", "t", "ref", {"ref_table": "absent", "ref_column": "key"}), DataTest("no_such", "t", "id", {})]
    got = {}
    for r in failing_samples({"t": t, "p": p}, tests, {"t": ["id"]}, k=3).collect():
        got.setdefault(r.test_id, []).append((r.place, int(r.row_key)))
        assert f'"id":{r.row_key}' in r.row
    ids = {k: sorted(x for _, x in v) for k, v in got.items()}
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    assert set(ids["value_range:t.txt"]) <= {0, 2, 4, 6, 8, 10} and ids["value_range:t.num"] == [0, 1, 4] and ids["null_rate:t.n"] == [5]
    assert len(ids["enum:t.n"]) == 3 and len(ids["unique:t.ref"]) == 3 and set(ids["fk_resolves:t.ref"]) <= {8, 9, 10, 11}
    assert ids["cross_field:t.id"] == [0, 1] and set(ids["length:t.txt"]) <= {1, 3, 5, 7, 9, 11} and "no_such:t.id" not in ids
    assert failing_samples({"t": t}, [], {}).count() == 0


def test_text_references(spark):
    child = spark.createDataFrame([("1",), ("x",), (" 2",), (None,), ("9",)], "r string")
    parent = spark.createDataFrame([(1,), (2,)], "k long")
    test = [DataTest("fk_resolves", "c", "r", {"ref_table": "p", "ref_column": "k"})]
    assert run_tests({"c": child, "p": parent}, test).first().bad_count == 2
    swapped = [DataTest("fk_resolves", "p", "k", {"ref_table": "c", "ref_column": "r"})]
    assert run_tests({"c": child, "p": parent}, swapped).first().passed


def test_edits_of_null_keys(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, None, "b"), (None, 2, "c")], "k int, j int, v string")
    edits = spark.createDataFrame([(None, None, "v", "B"), (None, 2, "v", "C"), (3, None, "v", "D")], "k int, j int, column string, value string")
    assert sorted(r.v for r in apply_edits(df, ["k", "j"], edits).collect()) == ["B", "C", "a"]
    assert [r.value for r in unapplied_edits(df, ["k", "j"], edits).collect()] == ["D"]


def test_ranges_without_nan(spark):
    df = spark.createDataFrame([(1.0, math.nan), (math.nan, math.nan), (3.0, math.nan)], "x double, y double")
    got = suggest_rules(spark, {"t": df}).collect()
    assert [(r.column_name, r.min_value, r.max_value, r.reason) for r in got] == [("x", "1.0", "3.0", "observed 1.0..3.0, 1 NaN")]


def test_profile_of_wide_decimals(spark):
    df = spark.createDataFrame([(Decimal("0." + "1" * 30), Decimal(10) ** 30)] * 2, "small decimal(38,30), large decimal(38,2)")
    got = {r.column_name: r for r in exact_profile(df).collect()}
    assert got["small"].distinct_values == got["large"].distinct_values == 1 and got["small"].min_value.startswith("0.1111")
