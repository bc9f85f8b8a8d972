"""Key and foreign-key discovery on data.

Keys: a column is a key when it has no nulls and as many distinct values as rows.  One aggregate
pass per table gives rows, nulls, least and largest value.  A column is dropped only by a proof: nulls,
fewer integers between its least and largest value than rows, or a value repeated among the first
``PROOF_ROWS`` rows; all others of a table are checked exactly over all rows together, in one grouped
count of (column, value) pairs.  No estimate is used.

Foreign keys: a pair (child column, parent key) of the same type family (integers, strings, decimals,
dates, timestamps; not floats) is an FK when the child column has values and every non-null child value exists among the parent keys.  Child
columns whose min/max fits no key range are dropped up front; the rest are checked together in
one join per type family (see ``discover_fks``).  ``max_per_parent`` is the largest child count
of one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import run_concurrently
from .profile import _orderable

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Fixed value: rows searched for a repeated value before a column is checked over all rows.
PROOF_ROWS = 10_000
FAMILIES = {"int": INTEGRAL, "string": T.StringType, "decimal": T.DecimalType, "date": T.DateType,
            "timestamp": (T.TimestampType, T.TimestampNTZType)}


def _family(dtype: T.DataType) -> str | None:
    return next((f for f, types in FAMILIES.items() if isinstance(dtype, types)), None)


def _value(column: str, family: str) -> Column:
    """A value as its family compares it; decimals as text without the zeros their scale adds."""
    if family != "decimal":
        return F.col(column).cast({"int": "long"}.get(family, family))
    text = F.col(column).cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def column_stats(df: DataFrame) -> dict:
    aggs = [F.count(F.lit(1)).alias("__rows")]
    cols = [f for f in df.schema.fields if _orderable(f.dataType)]
    for i, f in enumerate(cols):
        c = F.col(f.name)
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"),
                 F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    r = df.agg(*aggs).first()
    return {"rows": r["__rows"], "columns": {f.name: {"nulls": r[f"n{i}"],
                                                      "min": r[f"lo{i}"], "max": r[f"hi{i}"],
                                                      "type": f.dataType}
                                             for i, f in enumerate(cols)}}


def _repeated_columns(df: DataFrame, columns: list[str]) -> set[str]:
    """Columns (among ``columns``) holding a repeated value — one grouped job for all of them:
    (column, value) pairs are counted with map-side combining, so a task forwards each distinct
    pair once.  Values are compared in their text form, which is exact for keys (integers,
    strings, dates, round-trip float text with one zero)."""
    if not columns:
        return set()
    text = {f.name: (F.col(f.name) + F.lit(0.0) if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType)
                     else F.col(f.name)).cast("string") for f in df.schema.fields if f.name in columns}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), text[c].alias("v")) for c in columns])).alias("p"))
    dup = (pairs.select("p.c", "p.v").groupBy("c", "v").count().where(F.col("count") > 1)
           .select("c").distinct().collect())
    return {r.c for r in dup}


def all_column_stats(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """``column_stats`` of every table, the per-table jobs submitted concurrently."""
    names = list(tables)
    res = run_concurrently([lambda n=n: column_stats(tables[n]) for n in names])
    return dict(zip(names, res, strict=True))


def discover_keys(spark: SparkSession, tables: dict[str, DataFrame],
                  stats: dict[str, dict] | None = None) -> DataFrame:
    """(table_name, column_name, is_key) for every orderable column."""
    stats = stats or all_column_stats(tables)
    names = list(tables)

    def open_columns(name: str) -> list[str]:
        n = stats[name]["rows"]
        return [c for c, s in stats[name]["columns"].items() if n > 0 and s["nulls"] == 0
                and not (isinstance(s["type"], INTEGRAL) and s["max"] - s["min"] + 1 < n)]

    def check(name: str) -> set[str]:
        """Columns that hold each value once."""
        columns = open_columns(name)
        if stats[name]["rows"] > PROOF_ROWS and columns:
            early = _repeated_columns(tables[name].select(*columns).limit(PROOF_ROWS), columns)
            columns = [c for c in columns if c not in early]
        return set(columns) - _repeated_columns(tables[name], columns)

    keys = dict(zip(names, run_concurrently([lambda n=n: check(n) for n in names]), strict=True))
    rows = []
    for name in names:
        for col in stats[name]["columns"]:
            rows.append((name, col, col in keys[name]))
    return spark.createDataFrame(rows, "table_name string, column_name string, is_key boolean")


def discover_fks(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(child_table, child_column, parent_table, parent_column, max_per_parent) for every pair
    whose child values all resolve to a parent key.

    One job per type family: child columns are reduced to distinct (column, value, rows), key
    columns to (key, value); an inner join on value counts, per pair, how many distinct child
    values found a parent.  A pair is an FK when that equals the child's distinct count.  Both
    join sides are duplicate-free per column, so no value can be hot."""
    stats = all_column_stats(tables)
    keys = [(r.table_name, r.column_name) for r in discover_keys(spark, tables, stats).collect()
            if r.is_key]
    out = None
    for fam in FAMILIES:
        kcols = [(t, c) for t, c in keys if _family(stats[t]["columns"][c]["type"]) == fam]
        children = [(t, c) for t, st in stats.items() for c, cs in st["columns"].items()
                    if _family(cs["type"]) == fam and cs["nulls"] < st["rows"]
                    and any((t, c) != k and cs["min"] >= stats[k[0]]["columns"][k[1]]["min"]
                            and cs["max"] <= stats[k[0]]["columns"][k[1]]["max"] for k in kcols)]
        if not kcols or not children:
            continue
        child_vals = None
        for t, c in children:
            part = (tables[t].where(F.col(c).isNotNull())
                    .groupBy(_value(c, fam).alias("__k")).agg(F.count(F.lit(1)).alias("n"))
                    .select(F.lit(t).alias("child_table"), F.lit(c).alias("child_column"), "__k", "n"))
            child_vals = part if child_vals is None else child_vals.unionByName(part)
        key_vals = None
        for t, c in kcols:
            part = tables[t].select(F.lit(t).alias("parent_table"), F.lit(c).alias("parent_column"),
                                    _value(c, fam).alias("__k"))
            key_vals = part if key_vals is None else key_vals.unionByName(part)
        per_child = child_vals.groupBy("child_table", "child_column").agg(
            F.count(F.lit(1)).alias("distinct_values"), F.max("n").alias("max_per_parent"))
        matched = child_vals.join(key_vals, "__k").groupBy(
            "child_table", "child_column", "parent_table", "parent_column").agg(
            F.count(F.lit(1)).alias("matched"))
        fks = matched.join(per_child, ["child_table", "child_column"]).where(
            (F.col("matched") == F.col("distinct_values"))
            & ~((F.col("child_table") == F.col("parent_table"))
                & (F.col("child_column") == F.col("parent_column")))
        ).select("child_table", "child_column", "parent_table", "parent_column", "max_per_parent")
        out = fks if out is None else out.unionByName(fks)
    if out is None:
        return spark.createDataFrame([], "child_table string, child_column string, parent_table string, "
                                         "parent_column string, max_per_parent long")
    return out
