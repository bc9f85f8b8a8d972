"""Hot keys: one key holding a third of all rows, and parents with very many children."""

from pyspark.sql import functions as F

from ferrule.operators import expand
from ferrule.operators.datatests import DataTest, run_tests
from ferrule.operators.generate import _expand, spine
from ferrule.operators.subset import consistent_subset


def _expanded(spark):
    parents = spine(spark, 50).select(F.col("__row").alias("__prow"),
                                      (F.col("__row") + 100).alias("__pkey"))
    return _expand(parents, 50, 9, "child", "fk", 0, 5000).select("__row", "__pkey")


def test_chunked_explode_equals_plain(spark, monkeypatch):
    plain = _expanded(spark)
    monkeypatch.setattr(expand, "EXPLODE_CHUNK", 700)  # force parents into chunks
    chunked = _expanded(spark)
    n = plain.count()
    assert chunked.count() == n
    assert plain.exceptAll(chunked).count() == 0
    r = chunked.agg(F.min("__row"), F.max("__row"), F.countDistinct("__row")).first()
    assert tuple(r) == (0, n - 1, n)


def test_hot_key_tests_and_joins(spark):
    hot = spark.range(0, 30000).select(
        F.col("id").alias("line_id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("order_id"),
        (F.col("id") % 11).alias("qty"))
    orders = spark.range(0, 30000).select(F.col("id").alias("order_id"),
                                          (F.col("id") % 500).alias("cust_id"),
                                          F.lit(5).alias("min_qty"))
    tests = [DataTest("unique", "lines", "order_id"),
             DataTest("fk_resolves", "lines", "order_id", {"ref_table": "orders", "ref_column": "order_id"}),
             DataTest("fk_cardinality", "lines", "order_id", {"max_per_parent": 1}),
             DataTest("cross_field", "lines", "qty", {"ref_table": "orders", "on": [["order_id", "order_id"]],
                                                     "expr": "qty >= min_qty"})]
    r = {x.test_id: x.bad_count for x in run_tests({"lines": hot, "orders": orders}, tests).collect()}
    assert r["unique:lines.order_id"] == 10000         # 10001 rows share key 7
    assert r["fk_resolves:lines.order_id"] == 0
    assert r["fk_cardinality:lines.order_id"] == 1
    assert r["cross_field:lines.qty"] == hot.where("qty < 5").count()
    sel = consistent_subset({"orders": orders, "lines": hot}, "orders", "order_id", 0.5, 3,
                            [("lines", "order_id", "orders", "order_id")], [])
    assert sel["lines"].join(sel["orders"], "order_id", "left_anti").count() == 0
