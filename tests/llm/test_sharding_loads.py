"""Overfull ranges and records with many copies (op4)."""

import zlib

import pytest
from pyspark.sql import functions as F

from ferrule.llm import sharding

from helpers import documents


@pytest.fixture
def apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_many_records_of_few_bytes_are_spread(spark, monkeypatch):
    seen, plain = [], sharding._range_of
    monkeypatch.setattr(sharding, "_range_of", lambda cuts: seen.append(cuts) or plain(cuts))
    monkeypatch.setattr(sharding, "LEAST_CUT", 30, raising=False)
    rows = [(i, "", None) for i in range(3000)] + [(5000 + i, f"text {i} " * 60, None) for i in range(3000)]
    docs = documents(spark, rows)
    got = sharding.shards(docs, 8, ranges=64).collect()
    dealt = sharding.records(docs).withColumn("rng", plain(seen[-1])).groupBy("rng").count()
    assert dealt.agg(F.max("count")).first()[0] < 800
    assert len(got) == 6000 and sorted(r.doc_id for r in got) == sorted(d for d, *_ in rows)
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"")}) == 1  # lighter than a range: stays whole
    by = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(by) - min(by) <= 0.03 * sum(by)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_copies_are_unfolded_in_several_tasks(spark, monkeypatch, apart):
    monkeypatch.setattr(sharding, "UNFOLD", 100, raising=False)
    tasks, plain = [], sharding.stored

    def stored(df, name):
        if name == "shard-places":
            tasks.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        return plain(df, name)
    monkeypatch.setattr(sharding, "stored", stored)
    same = [(None, "same row", None)] * 2000
    got = sharding.shards(documents(spark, same), 4).collect()
    assert sum(tasks) == 2000 and max(tasks) < 2000
    assert [sum(r.shard == s for r in got) for s in range(4)] == [500] * 4
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(500)) for s in range(4))
