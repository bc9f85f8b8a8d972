"""Dense numbering over keys of any values, and chunks as one plan."""

from pyspark.sql import functions as F

from conftest import GOLDEN
from ferrule.operators.expand import dense_index
from ferrule.operators.generate import generate_table
from ferrule.plans.spec import parse_spec
from ferrule.sinks.files import row_numbers
from ferrule.streaming import chunks


def _keys(spark):
    ends = spark.createDataFrame([(-2**63,), (2**63 - 1,), (2**61,)], "k long")
    return spark.range(20_000).select(F.col("id").alias("k")).union(ends)


def test_numbers_of_keys_at_both_ends_of_int64(spark):
    want = {k: i for i, k in enumerate(sorted([-2**63, *range(20_000), 2**61, 2**63 - 1]))}
    idx, m = dense_index(_keys(spark), "k")
    assert m == len(want) and {r.k: r["__row"] for r in idx.collect()} == want
    rows = row_numbers(_keys(spark), ["k"], unique_key=True)
    assert {r.k: r["__idx"] for r in rows.collect()} == want
    empty, none = dense_index(_keys(spark).where("k = 5 AND k = 6"), "k")
    assert none == 0 and empty.count() == 0


def test_a_far_key_leaves_the_others_spread(spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        idx, _ = dense_index(_keys(spark).where("k >= 0"), "k")
        largest = idx.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert largest < 10_000


def test_chunks_are_one_plan(spark):
    t = parse_spec(GOLDEN).table("wells")
    one, whole = chunks.chunked_table(spark, t, 42, 230, 100), generate_table(spark, t, 42, n=230)
    assert one.columns == whole.columns and one.exceptAll(whole).count() == 0 and whole.exceptAll(one).count() == 0
