from pyspark.sql import functions as F

from ferrule.session import (MAX_SHUFFLE_PARTITIONS, checkpoint_dir, scratch_path, size_shuffles,
                             spread)


def test_size_shuffles_monotone_and_capped(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        assert size_shuffles(spark, 1000) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert spark.conf.get(key, None) is None          # small input: setting untouched
        big = size_shuffles(spark, 64 * 1000 * (64 << 20))
        assert big == 64 * 1000 and spark.conf.get(key) == str(big)
        assert size_shuffles(spark, 1000) == big          # never lowered
        assert size_shuffles(spark, 10 ** 18) == MAX_SHUFFLE_PARTITIONS
    finally:
        spark.conf.unset(key)
        if before:
            spark.conf.set(key, before)


def test_spread_only_fans_out_unshuffled_inputs(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(0, 1000).coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path)
    assert scan.rdd.getNumPartitions() == 1
    assert spread(scan, min_partitions=4).rdd.getNumPartitions() == 4
    shuffled = scan.groupBy((F.col("id") % 7).alias("k")).count()
    assert spread(shuffled, min_partitions=4) is shuffled   # left alone, nothing executed


def test_scratch_paths_live_under_the_checkpoint_dir(spark):
    base = checkpoint_dir(spark)
    assert scratch_path(spark, "x").startswith(base)
