"""Generation from examples: values drawn with the frequencies observed in a source column.

The source column is reduced to (value, count) by a map-side-combined aggregate, stored in value
order over range partitions; totals per partition and a window inside each give every value its
slice [lo, hi) of 0..total, in exact integer counts.  A generated row draws a 63-bit number below
the total and finds its value by a bucketized range join: the total is cut into up to 2^20 equal
buckets, a value is listed in the buckets its slice touches, and bucket plus range match exactly
one value.  Spark chooses the join by size.

``quantile_column`` reads the same slices as an inverse distribution function: a draw's place inside
its slice, refined by a second draw, moves it towards the next larger value, so numbers between the
observed ones come out too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draw import derive_seed, with_draws
from ..functions.generators import _draw63
from ..session import scratch_path, spread

# Fixed value of the plan shape.
BUCKETS = 1 << 20


def value_cuts(source: DataFrame, column: str) -> tuple[DataFrame, int]:
    """((value, lo, hi), rows with a value): slices proportional to observed counts, in value order."""
    spark = source.sparkSession
    counts = source.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, f"value-counts-{uuid.uuid4().hex[:12]}")
    counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()).write.parquet(path)
    counts = spark.read.parquet(path)
    start, offsets = 0, []
    for r in counts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row a partition
        offsets.append((r.part, start))
        start += r.n
    inside = Window.partitionBy("part").orderBy("value")
    cuts = counts.join(F.broadcast(spark.createDataFrame(offsets, "part int, start long")), "part").withColumn(
        "hi", F.col("start") + F.sum("n").over(inside))
    return cuts.select("value", (F.col("hi") - F.col("n")).alias("lo"), "hi"), start


def _drawn(spine: DataFrame, index_col: str, cuts: DataFrame, total: int, seed: int, table: str, out: str,
           more: list[str]) -> DataFrame:
    """``spine`` with the cut that a 63-bit draw below ``total`` falls in, the draw ``__e_<out>``, and one
    32-bit draw per name of ``more``."""
    step = max(1, -(-total // BUCKETS))
    per_bucket = cuts.select("*", F.explode(F.sequence(F.expr(f"lo div {step}"), F.expr(f"(hi - 1) div {step}"))).alias("__b"))
    names = [f"__e0_{out}", f"__e1_{out}"]
    seeds = [derive_seed(seed, table, out), *[derive_seed(seed, table, out, f"__draw{k + 1}__") for k in range(1 + len(more))]]
    d = f"__e_{out}"
    rows = with_draws(spread(spine), index_col, dict(zip([*names, *more], seeds)), barrier=True)
    rows = rows.withColumn(d, _draw63(*map(F.col, names)) % F.lit(total).cast("long")).withColumn("__b", F.expr(f"`{d}` div {step}"))
    joined = rows.join(per_bucket, "__b").where((F.col(d) >= F.col("lo")) & (F.col(d) < F.col("hi")))
    return joined.drop("__b", *names)


def empirical_column(spine: DataFrame, index_col: str, source: DataFrame, column: str, seed: int,
                     table: str, out: str) -> DataFrame:
    """Add ``out`` to every ``spine`` row: a value of ``source.column`` drawn with its observed
    frequency (draw indexed by ``index_col``); NULL if the source has no value."""
    cuts, total = value_cuts(source, column)
    if not total:
        return spine.withColumn(out, F.lit(None).cast(source.schema[column].dataType))
    joined = _drawn(spine, index_col, cuts, total, seed, table, out, [])
    return joined.drop("lo", "hi", f"__e_{out}").withColumnRenamed("value", out)


def quantile_column(spine: DataFrame, index_col: str, source: DataFrame, column: str, seed: int,
                    table: str, out: str) -> DataFrame:
    """Add ``out`` (double) to every ``spine`` row, drawn by the inverse of the observed distribution of the
    numbers ``source.column``: within the slice of a value it rises in a straight line to the next
    larger value; the largest value stays itself.  NaN is no value; NULL if there is none."""
    number = F.col(column).cast("double")
    cuts, total = value_cuts(source.select(F.when(~F.isnan(number), number).alias(column)), column)
    if not total:
        return spine.withColumn(out, F.lit(None).cast("double"))
    following = cuts.select(F.col("lo").alias("hi"), F.col("value").alias("next"))
    joined = _drawn(spine, index_col, cuts.join(following, "hi", "left"), total, seed, table, out, [f"__f_{out}"])
    inside = ((F.col(f"__e_{out}") - F.col("lo")) + F.col(f"__f_{out}") / float(1 << 32)) / (F.col("hi") - F.col("lo"))
    value = F.coalesce(F.col("value") + (F.col("next") - F.col("value")) * inside, F.col("value"))
    return joined.withColumn(out, value).drop("lo", "hi", "value", "next", f"__e_{out}", f"__f_{out}")
