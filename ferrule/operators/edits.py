"""Row edits applied to a keyed table (then re-validated by running the data tests again).

Edits are rows (key..., column, value-as-text).  They are grouped per key into a map (one
shuffle on the key, map-side combined), left-joined to the table, and each edited column takes
the edit's value cast to the column's type; the last edit of a (key, column) by ``seq`` wins, and
two last edits that differ are an error.  ``unapplied_edits`` returns the edits that changed
nothing because their key, or their column, is not there or the column is part of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_edits(df: DataFrame, key: list[str], edits: DataFrame) -> DataFrame:
    seq = F.col("seq") if "seq" in edits.columns else F.lit(0)
    same = edits.select(*key, "column", F.col("value").cast("string").alias("value"), seq.alias("__seq")) \
        .groupBy(*key, "column", "__seq").agg(
            F.min(F.struct(F.col("value").isNull().alias("n"), "value")).alias("lo"),
            F.max(F.struct(F.col("value").isNull().alias("n"), "value")).alias("hi"))
    last = same.groupBy(*key, "column").agg(F.max_by(F.struct("lo", "hi"), "__seq").alias("e"))
    latest = last.select(*key, "column", F.when(F.col("e.lo").eqNullSafe(F.col("e.hi")), F.col("e.lo.value")).otherwise(
        F.raise_error(F.concat(F.lit("two last edits of column "), F.col("column"))).cast("string")).alias("value"))
    per_key = latest.groupBy(*key).agg(F.map_from_entries(F.collect_list(
        F.struct("column", "value"))).alias("__edits"))
    renamed = per_key.select(*[F.col(k).alias(f"__{k}") for k in key], "__edits")
    j = df.join(renamed, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "left")  # NULL is a key as well
    out = []
    for f in df.schema.fields:
        if f.name in key:
            out.append(F.col(f.name))
            continue
        has = F.coalesce(F.map_contains_key(F.col("__edits"), F.lit(f.name)), F.lit(False))
        new = F.col("__edits")[f.name].cast(f.dataType)
        out.append(F.when(has, new).otherwise(F.col(f.name)).alias(f.name))
    return j.select(*out)


def unapplied_edits(df: DataFrame, key: list[str], edits: DataFrame) -> DataFrame:
    """The edits (all their columns) with a ``reason``: no_such_column, key_column or no_such_key."""
    columns = [c for c in df.columns if c not in key]
    keys = df.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct().withColumn("__there", F.lit(True))
    hit = edits.join(keys, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "left")
    reason = (F.when(F.col("column").isin(key), "key_column")
              .when(F.col("column").isNull() | ~F.col("column").isin(columns), "no_such_column")
              .when(F.col("__there").isNull(), "no_such_key"))
    return hit.withColumn("reason", reason).where("reason IS NOT NULL").select(*edits.columns, "reason")
