"""Exact column distributions from one count of (column, value).

All columns of a table are unpivoted into (pos, value) and counted by one map-side-combined
aggregate, whatever their number.  A value is carried as (i, d, s): whole and decimal numbers, dates,
timestamps and booleans in ``i`` (decimal), floating numbers in ``d``, text in ``s``, so one order
serves all.  ``running_totals`` puts the counts into ranges of that order and adds exact running sums;
quantiles, distinct counts, extremes and the largest gap between two distributions are read off them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

ORDER = ["i", "d", "s"]
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = (*WHOLE, *FLOATING, T.DecimalType)


def running_totals(df: DataFrame, group: list[str], order: list[str], weights: dict[str, str]) -> DataFrame:
    """Add, for every ``out: weight`` of ``weights``, the sum of ``weight`` over the rows of the same group
    before this one in ``order`` (``group`` + ``order`` must identify a row).

    Rows are stored in ranges of (group, order) that follow the rows, so a group that holds most of
    them is spread; a range's share of a group gets its offset from the shares before it (as many
    rows a group as it spans ranges), and inside a share a window runs."""
    spark = df.sparkSession
    path = scratch_path(spark, f"running-{uuid.uuid4().hex[:12]}")
    df.write.parquet(f"{path}/rows")  # ranges are sampled first: stored, so that the sample costs no second run of ``df``
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows")
    parts = rows.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id())
    parts.write.parquet(f"{path}/ranges")
    parts = spark.read.schema(parts.schema).parquet(f"{path}/ranges")
    share = parts.groupBy("__part", *group).agg(*[F.sum(w).alias(f"__{out}") for out, w in weights.items()])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = share.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in group],
                           *[F.coalesce(F.sum(f"__{out}").over(before), F.lit(0)).alias(f"__{out}") for out in weights])
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group], F.col("__part") == F.col("__p"))
    inside = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {out: F.col(f"__{out}") + F.sum(w).over(inside) - F.col(w) for out, w in weights.items()}
    return parts.join(offsets, same).select(*df.columns, *[c.alias(out) for out, c in sums.items()])


def _scale(df: DataFrame, columns: list[str]) -> int:
    """The scale that holds every decimal of the columns, as far as whole numbers keep 20 digits."""
    return min(18, max([0, *[df.schema[c].dataType.scale for c in columns if isinstance(df.schema[c].dataType, T.DecimalType)]]))


def _cell(df: DataFrame, pos: int, name: str, scale: int) -> Column:
    c, t = F.col(f"`{name}`"), df.schema[name].dataType
    i, d, s = F.lit(None), F.lit(None), F.lit(None)
    if isinstance(t, T.DecimalType) and (t.scale > scale or t.precision - t.scale > 38 - scale):
        d, s = c.cast("double"), c.cast("string")
    elif isinstance(t, (*WHOLE, T.DecimalType)):
        i = c
    elif isinstance(t, T.BooleanType):
        i = c.cast("int")
    elif isinstance(t, T.DateType):
        i = F.unix_date(c)
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        i = F.unix_micros(c.cast("timestamp"))
    elif isinstance(t, FLOATING):
        d = c.cast("double")
    elif isinstance(t, T.StringType):
        s = c
    return F.struct(F.lit(pos).alias("pos"), c.isNotNull().alias("present"), i.cast(T.DecimalType(38, scale)).alias("i"),
                    d.cast("double").alias("d"), s.cast("string").alias("s"))


def column_counts(df: DataFrame, columns: list[str], scale: int | None = None) -> DataFrame:
    """pos, present, i, d, s, n: how often every value of every column occurs (NULL: not present)."""
    scale = _scale(df, columns) if scale is None else scale
    cells = F.explode(F.array(*[_cell(df, p, c, scale) for p, c in enumerate(columns)]))
    return df.select(cells.alias("c")).select("c.*").groupBy("pos", "present", *ORDER).agg(F.count(F.lit(1)).alias("n"))


def _of_type(df: DataFrame, columns: list[str], pick=F.col) -> Column:
    """Text of a counted value, in its own column's type."""
    out = F.lit(None).cast("string")
    for p, name in enumerate(columns):
        t = df.schema[name].dataType
        if isinstance(t, T.DateType):
            text = F.date_from_unix_date(pick("i").cast("int")).cast("string")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            text = F.timestamp_micros(pick("i").cast("long")).cast("timestamp_ntz").cast("string")
        elif isinstance(t, T.BooleanType):
            text = pick("i").cast("int").cast("boolean").cast("string")
        elif isinstance(t, (*WHOLE, T.DecimalType)):
            text = F.coalesce(pick("s"), pick("i").cast(t).cast("string"))
        elif isinstance(t, FLOATING):
            text = pick("d").cast(t).cast("string")
        else:
            text = pick("s")
        out = F.when(F.col("pos") == p, text).otherwise(out)
    return out


def exact_profile(df: DataFrame, top_k: int = 10, quantiles: tuple[int, int, int] = (1, 2, 3)) -> DataFrame:
    """One row per column: column_name, data_type, rows, nulls, null_rate (NULL without rows), distinct_values,
    min_value, max_value (text), quartiles of numeric columns (the smallest value with at least that
    share of the values up to it; a NaN counts as the largest number) and top_values, the ``top_k`` most
    frequent values with counts (ties: smallest text first).  All exact; columns without an order
    (arrays, maps, binary) have rows and nulls only."""
    columns, spark = df.columns, df.sparkSession
    ordered = [p for p, f in enumerate(df.schema.fields) if isinstance(f.dataType, (
        *NUMERIC, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    numeric = [p for p, f in enumerate(df.schema.fields) if isinstance(f.dataType, NUMERIC)]
    counts = running_totals(column_counts(df, columns), ["pos", "present"], ORDER, {"start": "n"})
    values = counts.where(F.col("present") & F.col("pos").isin(ordered))
    key = F.struct(*ORDER)
    per = counts.groupBy("pos").agg(
        F.sum("n").alias("rows"), F.sum(F.when(~F.col("present"), F.col("n")).otherwise(0)).alias("nulls"),
        F.count_if("present").alias("distinct_values"), F.min(F.when(F.col("present"), key)).alias("lo"),
        F.max(F.when(F.col("present"), key)).alias("hi"))
    is_ordered = F.col("pos").isin(ordered)
    stats = per.select("pos", "rows", "nulls", F.when(is_ordered, F.col("distinct_values")).alias("distinct_values"),
                       _of_type(df, columns, lambda n: F.col(f"lo.{n}")).alias("min_value"),
                       _of_type(df, columns, lambda n: F.col(f"hi.{n}")).alias("max_value"))
    size = F.broadcast(per.select("pos", (F.col("rows") - F.col("nulls")).alias("m")))  # a row a column
    at = [F.expr(f"(m * {k} + 3) div 4") for k in quantiles]
    number = F.coalesce(F.col("i").cast("double"), F.col("d"))
    quartiles = (values.where(F.col("pos").isin(numeric)).join(size, "pos").groupBy("pos").agg(F.array(*[
        F.max(F.when((F.col("start") < t) & (t <= F.col("start") + F.col("n")), number)) for t in at]).alias("quartiles")))
    text = values.select("pos", "n", _of_type(df, columns).alias("v"))
    place = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("n"), "v"))
    top = (text.withColumn("place", place).where(F.col("place") <= top_k)
           .groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("place", "v", "n"))).alias("t"))
           .select("pos", F.transform("t", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("count"))).alias("top_values")))
    names = spark.createDataFrame([(p, f.name, f.dataType.simpleString()) for p, f in enumerate(df.schema.fields)],
                                  "pos int, column_name string, data_type string")
    out = names.join(stats, "pos", "left").join(quartiles, "pos", "left").join(top, "pos", "left")
    zero = F.lit(0).cast("long")
    rows, nulls = F.coalesce("rows", zero), F.coalesce("nulls", zero)
    return out.select("column_name", "data_type", rows.alias("rows"), nulls.alias("nulls"),
                      F.when(rows > 0, nulls / rows).alias("null_rate"),
                      F.when(is_ordered, F.coalesce("distinct_values", zero)).alias("distinct_values"),
                      "min_value", "max_value", "quartiles", "top_values")


def two_sample_distance(source: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: column_name, ks (largest gap between the two cumulative shares over all values,
    no bins), rows with a value, null_rate and distinct values of both sides, null_gap and
    distinct_gap (1 - smaller / larger count).

    A side without values is at distance 1 from any other, and two such sides at 0; a null rate
    without rows is NULL and its gap too."""
    scale = max(_scale(source, columns), _scale(other, columns))
    sides = [column_counts(df, columns, scale).withColumn("side", F.lit(k)) for k, df in enumerate((source, other))]
    tagged = sides[0].unionByName(sides[1])
    both = tagged.groupBy("pos", "present", *ORDER).agg(*[
        F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    counts = running_totals(both, ["pos", "present"], ORDER, {"c0": "n0", "c1": "n1"})
    there = F.col("present")
    total = counts.groupBy("pos").agg(*[a for k in (0, 1) for a in (
        F.sum(F.when(there, F.col(f"n{k}")).otherwise(0)).alias(f"values{k}"), F.sum(f"n{k}").alias(f"rows{k}"),
        F.count_if(there & (F.col(f"n{k}") > 0)).alias(f"distinct{k}"))])
    wide = [(F.col(f"c{k}") + F.col(f"n{k}")).cast(T.DecimalType(19, 0)) * F.col(f"values{1 - k}").cast(T.DecimalType(19, 0)) for k in (0, 1)]
    gap = counts.where(there).join(F.broadcast(total.select("pos", "values0", "values1")), "pos").groupBy("pos").agg(
        F.max(F.abs(wide[0] - wide[1])).alias("gap"))
    names = source.sparkSession.createDataFrame(list(enumerate(columns)), "pos int, column_name string")
    zero = F.lit(0).cast("long")
    out = names.join(total, "pos", "left").join(gap, "pos", "left")
    v0, v1, r0, r1, d0, d1 = (F.coalesce(c, zero) for c in ("values0", "values1", "rows0", "rows1", "distinct0", "distinct1"))
    ks = (F.when((v0 == 0) & (v1 == 0), F.lit(0.0)).when((v0 == 0) | (v1 == 0), F.lit(1.0))
          .otherwise(F.col("gap").cast("double") / (v0.cast("double") * v1.cast("double"))))
    null0, null1 = F.when(r0 > 0, (r0 - v0) / r0), F.when(r1 > 0, (r1 - v1) / r1)
    most = F.greatest(d0, d1)
    return out.select("column_name", ks.alias("ks"), v0.alias("values_source"), v1.alias("values_other"),
                      null0.alias("null_rate_source"), null1.alias("null_rate_other"), F.abs(null0 - null1).alias("null_gap"),
                      d0.alias("distinct_source"), d1.alias("distinct_other"),
                      F.when(most > 0, 1 - F.least(d0, d1) / most).otherwise(0.0).alias("distinct_gap"))
