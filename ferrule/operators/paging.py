"""Previews and paging over stored tables.

``page`` orders by a key (required: Spark tables have no file order), skips ``offset`` rows and
returns at most ``limit`` (clamped to 1..1000), with ``total_rows`` on every row.  Spark plans
``orderBy.offset.limit`` as a top-k (each task keeps only offset+limit rows), so a page costs one
scan and never sorts the whole table.

``build_page_index`` stores a table once in ranges of its order (ties broken by all its columns) with a
row a range: rows before it, rows in it, last key.  ``page_at`` and ``page_after`` read that index and
then only the ranges that hold the page, however deep it lies.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import json_safe

# Fixed values of paging.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000


def clamp_limit(limit: int | None) -> int:
    if limit is None:
        return DEFAULT_LIMIT
    return max(1, min(MAX_LIMIT, int(limit)))


def page(df: DataFrame, order_by: list[str], offset: int = 0, limit: int | None = None,
         json_safe_values: bool = False) -> DataFrame:
    if offset < 0:
        raise ValueError("offset must be ≥ 0")
    if not order_by:
        raise ValueError("paging needs an ordering key")
    total = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery, no join
    rows = df.orderBy(*order_by).offset(int(offset)).limit(clamp_limit(limit))
    if json_safe_values:
        rows = rows.select(*[json_safe(F.col(f.name), f.dataType).alias(f.name)
                             for f in df.schema.fields])
    return rows.withColumn("total_rows", total)


def build_page_index(df: DataFrame, order_by: list[str], path: str) -> None:
    """Store ``df`` under ``path`` in ranges of ``order_by`` and, at equal keys, of its other columns: ``rows``,
    a folder a range, and ``index``."""
    order = [*order_by, *[c for c in df.columns if c not in order_by]]
    staged = f"{path}/staged-{uuid.uuid4().hex[:12]}"  # sampled for the ranges and then dealt out: computed once
    df.write.parquet(staged)
    rows = df.sparkSession.read.schema(df.schema).parquet(staged)
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    ranges.write.mode("overwrite").partitionBy("__range").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(ranges.schema).parquet(f"{path}/rows")
    per = stored.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order)).alias("last"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    index = per.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    index.select("__range", "start", "n", "last").write.mode("overwrite").parquet(f"{path}/index")


def _ranges(spark: SparkSession, path: str, index: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of some ranges, in order, with ``__place`` inside their range (only their folders are read)."""
    fields = index.schema["last"].dataType.fields
    schema = T.StructType([*fields, T.StructField("__range", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("__range").isin(ids))
    own = Window.partitionBy("__range").orderBy(*[f.name for f in fields])
    return rows.withColumn("__place", F.row_number().over(own) - 1)


def page_at(spark: SparkSession, path: str, offset: int, limit: int | None = None) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit - 1`` of an indexed table, with ``row_no``."""
    if offset < 0:
        raise ValueError("offset must be ≥ 0")
    limit = clamp_limit(limit)
    index = spark.read.parquet(f"{path}/index")
    hit = index.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).select("__range", "start").collect()
    starts = spark.createDataFrame([(r["__range"], r["start"]) for r in hit], "__range int, __start long")  # at most the page's ranges
    rows = _ranges(spark, path, index, [r["__range"] for r in hit]).join(F.broadcast(starts), "__range")
    rows = rows.withColumn("row_no", F.col("__start") + F.col("__place")).where((F.col("row_no") >= offset) & (F.col("row_no") < offset + limit))
    return rows.drop("__range", "__start", "__place")


def page_after(spark: SparkSession, path: str, last: dict[str, Any], limit: int | None = None) -> DataFrame:
    """The next ``limit`` rows after the row ``last`` (all its columns), with ``row_no``; ``last`` itself need not
    be there any more.  Rows equal to ``last`` are not repeated."""
    index = spark.read.parquet(f"{path}/index")
    fields = index.schema["last"].dataType.fields
    key = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in fields])
    found = index.where(F.col("last") >= key).orderBy("__range").select("__range", "start").limit(1).collect()
    if not found:
        return page_at(spark, path, index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], limit)
    upto = _ranges(spark, path, index, [found[0]["__range"]]).where(F.struct(*[f.name for f in fields]) <= key).count()  # one range
    return page_at(spark, path, found[0]["start"] + upto, limit)
