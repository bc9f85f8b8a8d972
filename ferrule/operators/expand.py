"""Dense, partition-independent row numbering: expansion of parents by counts, and pool indexes.

Both use a two-level prefix sum instead of an unpartitioned window:

1. rows are put into ordered buckets.  Keys of any values are dealt by ranges that hold about the same
   number of rows and stored with their partition (``range_start``).  Keys known to be dense (parents
   numbered 0..n-1) are cut evenly (``bucket = (key - base) div width``, at most ``MAX_BUCKETS``), and keys
   without an order of their own by hash,
2. per-bucket totals (a small table, ≤ ``MAX_BUCKETS`` rows) get a running sum — this is the
   only single-task step and its size is bounded by construction, so it is safe to broadcast,
3. inside each bucket a running sum over ``partitionBy(bucket).orderBy(key)`` gives the local
   offset.

The numbering depends only on the keys, never on ``spark_partition_id`` or task order, so a
recomputed stage numbers rows identically.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# Fixed values of the plan shape.
MAX_BUCKETS = 100_000
MIN_BUCKET_ROWS = 4096
EXPLODE_CHUNK = 1 << 20          # children per exploded chunk of one parent


def bucket_width(key_range: int) -> int:
    return max(MIN_BUCKET_ROWS, -(-int(key_range) // MAX_BUCKETS))


def range_bucket(key: str, base: int, width: int) -> Column:
    return F.expr(f"(`{key}` - {int(base)}) div {int(width)}")


def prefix_start(df: DataFrame, bucket: Column, order_cols: list[str], weight: Column,
                 out: str = "__start") -> DataFrame:
    """Add ``out`` = exclusive running sum of ``weight`` in (bucket, order_cols) order."""
    df = df.withColumn("__bucket", bucket).withColumn("__w", weight.cast("long"))
    sums = df.groupBy("__bucket").agg(F.sum("__w").alias("__bsum"))
    offs = sums.select("__bucket", (F.sum("__bsum").over(Window.orderBy("__bucket"))
                                    - F.col("__bsum")).alias("__boff"))
    local = Window.partitionBy("__bucket").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    df = df.join(F.broadcast(offs), "__bucket")
    return (df.withColumn(out, F.col("__boff") + F.sum("__w").over(local) - F.col("__w"))
            .drop("__bucket", "__w", "__boff"))


def range_start(df: DataFrame, order_cols: list[str], weight: Column, out: str = "__start") -> DataFrame:
    """As ``prefix_start`` over partitions of the key range that follow the rows, whatever the keys:
    one far key or keys at both ends of their type leave the others spread, and nothing is subtracted."""
    spark = df.sparkSession
    path = scratch_path(spark, f"ranges-{uuid.uuid4().hex[:12]}")
    parts = df.withColumn("__w", weight.cast("long")).repartitionByRange(*order_cols).withColumn(
        "__part", F.spark_partition_id())
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    start, offsets = 0, []
    for r in parts.groupBy("__part").agg(F.sum("__w").alias("n")).orderBy("__part").collect():  # a row a partition
        offsets.append((r["__part"], start))
        start += r.n
    inside = Window.partitionBy("__part").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.join(F.broadcast(spark.createDataFrame(offsets, "__part int, __boff long")), "__part")
    return (parts.withColumn(out, F.col("__boff") + F.sum("__w").over(inside) - F.col("__w"))
            .drop("__part", "__w", "__boff"))


def explode_counts(df: DataFrame, start_col: str, count_col: str, row_col: str,
                   order_col: str, max_count: int | None = None) -> DataFrame:
    """Repeat each row ``count`` times with ``row_col`` = start .. start+count-1 and ``__pos``
    = 0 .. count-1.  Rows with more than ``EXPLODE_CHUNK`` copies are first split into chunks
    that are hash-distributed on (``order_col``, chunk), so no task explodes a hot row alone."""
    cnt = F.col(count_col)
    if max_count is None or max_count > EXPLODE_CHUNK:  # None: maximum unknown, chunk always
        chunks = df.withColumn(
            "__chunk", F.explode(F.sequence(F.lit(0).cast("long"),
                                            F.expr(f"(`{count_col}` - 1) div {EXPLODE_CHUNK}"))))
        first = F.col("__chunk") * EXPLODE_CHUNK          # position of the chunk's first copy
        chunks = chunks.withColumn("__len", F.least(F.lit(EXPLODE_CHUNK).cast("long"), cnt - first))
        chunks = chunks.repartition(order_col, "__chunk")
        out = chunks.withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"),
                                                            F.col("__len") - 1)))
        return (out.withColumn("__pos", first + F.col("__p"))
                .withColumn(row_col, F.col(start_col) + F.col("__pos"))
                .drop("__chunk", "__len", "__p"))
    out = df.withColumn("__pos", F.explode(F.sequence(F.lit(0).cast("long"), cnt - 1)))
    return out.withColumn(row_col, F.col(start_col) + F.col("__pos"))


def expand_by_counts(parents: DataFrame, order_col: str, count_col: str, key_range: int,
                     base: int = 0, max_count: int | None = None, row_col: str = "__row") -> DataFrame:
    """Repeat each parent row ``count`` times in ``order_col`` order (dense: base..base+key_range-1); the child rows get a dense
    index ``row_col`` = 0..Σcount-1 (children of parent j follow those of parent j-1)."""
    width = bucket_width(key_range)
    cnt = F.col(count_col)
    with_start = prefix_start(parents.where(cnt > 0), range_bucket(order_col, base, width),
                              [order_col], cnt)
    return explode_counts(with_start, "__start", count_col, row_col, order_col,
                          max_count if max_count is not None else 0).drop("__start")


def dense_index(df: DataFrame, key: str, out: str = "__row", distinct: bool = True) -> tuple[DataFrame, int]:
    """(keys with a dense index 0..m-1 in key order, m).  Nulls are dropped; ``distinct``
    removes repeated keys first.  Integral keys use ranges that follow the rows (index = rank by key);
    other keys use hash buckets and the index follows (bucket, key)."""
    keys = df.select(key).where(F.col(key).isNotNull())
    if distinct:
        keys = keys.distinct()
    dtype = keys.schema[key].dataType
    integral = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if integral:
        idx = range_start(keys, [key], F.lit(1), out)
        return idx, idx.count()
    m = keys.count()
    nb = max(1, min(MAX_BUCKETS, -(-m // MIN_BUCKET_ROWS)))
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(nb))
    return prefix_start(keys, bucket, [key], F.lit(1), out), m
