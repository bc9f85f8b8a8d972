"""Comparing tables and builds: digests, reproducibility, diffs, drift, fidelity, coverage.

Digest of a table = (rows, bit_xor of a row hash, sum of the row hash as decimal) — order-free,
computed with partial aggregates (one row per task crosses the shuffle).  A plain long sum
would overflow under ANSI mode, hence the decimal sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .distribution import running_totals
from .expand import explode_counts


def row_hash(df: DataFrame, columns: list[str] | None = None) -> F.Column:
    cols = columns or df.columns
    # a null-safe per-column hash so (NULL, x) and (x, NULL) differ
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in cols])


def table_digest(df: DataFrame, name: str) -> DataFrame:
    h = row_hash(df)
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.bit_xor(h), F.lit(0).cast("long")).alias("xor_hash"),
        F.coalesce(F.sum(h.cast(T.DecimalType(38, 0))), F.lit(0).cast(T.DecimalType(38, 0)))
        .alias("sum_hash"))


def compare_builds(first: dict[str, DataFrame], second: dict[str, DataFrame],
                   exact: bool = True) -> DataFrame:
    """Per table: row counts, schema equality, digest equality and, when ``exact``, the rows
    only in one build (``exceptAll`` both ways — a full shuffle, meant for checks).

    The per-side results are one-row aggregates; they are paired by a union and a group-by on
    the table name (no join)."""
    if set(first) != set(second):
        raise ValueError(f"table sets differ: {sorted(set(first) ^ set(second))}")
    parts = []
    for name in sorted(first):
        a, b = first[name], second[name]
        same_schema = a.schema == b.schema
        sides = [table_digest(a, name).withColumn("side", F.lit(1)),
                 table_digest(b, name).withColumn("side", F.lit(2))]
        if exact and same_schema:
            sides.append(a.exceptAll(b).agg(F.lit(name).alias("table_name"),
                                             F.count(F.lit(1)).alias("row_count"))
                         .withColumn("side", F.lit(3)))
            sides.append(b.exceptAll(a).agg(F.lit(name).alias("table_name"),
                                             F.count(F.lit(1)).alias("row_count"))
                         .withColumn("side", F.lit(4)))
        u = sides[0]
        for x in sides[1:]:
            u = u.unionByName(x, allowMissingColumns=True)

        def pick(col: str, side: int) -> F.Column:
            return F.max(F.when(F.col("side") == side, F.col(col)))

        row = u.groupBy("table_name").agg(
            pick("row_count", 1).alias("rows_first"), pick("row_count", 2).alias("rows_second"),
            F.lit(same_schema).alias("schema_equal"),
            ((pick("xor_hash", 1) == pick("xor_hash", 2)) & (pick("sum_hash", 1) == pick("sum_hash", 2))
             & (pick("row_count", 1) == pick("row_count", 2))).alias("digest_equal"),
            pick("row_count", 3).alias("only_in_first"), pick("row_count", 4).alias("only_in_second"))
        parts.append(row)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assert_reproducible(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> None:
    """Raise naming the first table whose two builds differ."""
    if sorted(first) != sorted(second):
        raise AssertionError(f"table names differ: {sorted(first)} vs {sorted(second)}")
    bad = compare_builds(first, second).where(
        ~F.col("schema_equal") | ~F.col("digest_equal") | (F.col("only_in_first") != 0)
        | (F.col("only_in_second") != 0)).select("table_name").limit(1).collect()
    if bad:
        raise AssertionError(f"table {bad[0][0]!r} differs between the two builds")


# --- dataset diff ---------------------------------------------------------------------------

def dataset_diff(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Per-column change counts between two versions of a table; keys may be NULL and may repeat.

    Rows that both sides hold equally often differ nowhere: both are counted by all their columns in
    one union (map-side combined), and only surplus rows go on.  Those of one key are paired across
    the sides in the order of their columns, the pairs are changed rows, and what finds no partner
    is added or removed.  A key with many surplus rows is spread over ranges (``running_totals``).

    Returns one row per column plus the ``__rows__`` row carrying added/removed/changed rows."""
    cols = [c for c in first.columns if c not in key and c in second.columns]
    keys = [f"k{i}" for i in range(len(key))]
    values = [f"v{i}" for i in range(len(cols))]

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(key, keys)], *[F.col(c).alias(n) for c, n in zip(cols, values)],
                         F.lit(sign).cast("long").alias("sign"))

    surplus = side(first, 1).unionByName(side(second, -1)).groupBy(*keys, *values).agg(F.sum("sign").alias("d")).where("d <> 0")
    surplus = surplus.select(*keys, *values, (F.col("d") > 0).alias("in_first"), F.abs("d").alias("n"))
    placed = running_totals(surplus, [*keys, "in_first"], values, {"start": "n"})
    # a row of n copies takes the places start .. start + n - 1 of its key and side
    placed = placed.withColumn("h", F.xxhash64(*keys, "start"))
    copies = explode_counts(placed, "start", "n", "place", "h")
    a, b = (copies.where("in_first" if first_side else "NOT in_first").select(
        *[F.col(c).alias(f"{x}_{c}") for c in (*keys, *values, "place")], F.lit(True).alias(f"in_{x}"))
        for x, first_side in (("a", True), ("b", False)))
    j = a.join(b, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in [*keys, "place"]], "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    changed = [both & ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) for v in values]
    one = j.agg(F.count_if(F.col("in_b").isNull()).alias("removed"), F.count_if(F.col("in_a").isNull()).alias("added"),
                F.count_if(both).alias("changed"), *[F.count_if(ch).alias(f"c{i}") for i, ch in enumerate(changed)])
    none = F.lit(0).cast("long")
    rows = [F.struct(F.lit("__rows__").alias("column_name"), F.col("added"), F.col("removed"), F.col("changed"))]
    rows += [F.struct(F.lit(c).alias("column_name"), none.alias("added"), none.alias("removed"), F.col(f"c{i}").alias("changed"))
             for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


# --- schema drift ---------------------------------------------------------------------------

def schema_drift(first: DataFrame, second: DataFrame) -> DataFrame:
    """(column_name, first_type, second_type, status ∈ {same, changed, added, removed},
    lossy_values): for a changed column, the non-null values of ``first`` that the second type
    does not hold exactly (the cast there and back differs, or fails) — one aggregate pass."""
    a = {f.name: f.dataType for f in first.schema.fields}
    b = {f.name: f.dataType for f in second.schema.fields}
    meta, aggs = [], []
    for i, name in enumerate(list(a) + [n for n in b if n not in a]):
        ta, tb = a.get(name), b.get(name)
        status = ("added" if ta is None else "removed" if tb is None
                  else "same" if ta == tb else "changed")
        if status == "changed":
            v = F.col(name)
            back = v.try_cast(tb).try_cast(ta)
            aggs.append(F.count_if(v.isNotNull() & ~back.eqNullSafe(v)).alias(f"l{i}"))
        else:
            aggs.append(F.lit(None).cast("long").alias(f"l{i}"))
        meta.append((name, None if ta is None else ta.simpleString(),
                     None if tb is None else tb.simpleString(), status))
    return first.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.lit(x).cast("string").alias("first_type"),
                 F.lit(y).cast("string").alias("second_type"), F.lit(s).alias("status"),
                 F.col(f"l{i}").alias("lossy_values"))
        for i, (n, x, y, s) in enumerate(meta)])))


# --- fidelity -------------------------------------------------------------------------------

def category_fidelity(source: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Distribution distance of a categorical column: total variation (½·Σ|p−q|) over the union
    of observed values, plus the share of source values never seen in ``other``.  Value counts
    are aggregated map-side on both sides, then outer-joined (one row per distinct value).
    A side without values is at distance 1 from any other, and two such sides at 0."""
    p = source.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(
        F.count(F.lit(1)).alias("np"))
    q = other.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(
        F.count(F.lit(1)).alias("nq"))
    tp = source.where(F.col(column).isNotNull()).agg(F.count(F.lit(1))).scalar()
    tq = other.where(F.col(column).isNotNull()).agg(F.count(F.lit(1))).scalar()
    j = p.join(q, "v", "full_outer")
    pp = F.coalesce(F.try_divide(F.col("np"), tp), F.lit(0.0))
    qq = F.coalesce(F.try_divide(F.col("nq"), tq), F.lit(0.0))
    return j.agg(
        F.lit(column).alias("column_name"), _unless_empty(F.sum(F.abs(pp - qq)) / 2, "np", "nq").alias("tvd"),
        F.coalesce(F.sum(F.when(F.col("nq").isNull(), pp)), F.lit(0.0)).alias("unseen_share"))


def _unless_empty(distance: Column, np: str, nq: str) -> Column:
    """An aggregate of two columns of counts: 1 if only one side has values, 0 if none has."""
    p, q = (F.coalesce(F.sum(c), F.lit(0)) > 0 for c in (np, nq))
    return F.when(p & q, distance).otherwise(F.when(p | q, F.lit(1.0)).otherwise(F.lit(0.0)))


def numeric_fidelity(source: DataFrame, other: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Histogram distances of a numeric column over ``bins`` equal-width bins of the source's
    [min, max] (values outside fall into the end bins): total variation, KS (largest gap of
    the cumulative shares) and PSI with a 1e-6 floor per bin.  A side without values is at
    distance 1 from any other, and two such sides at 0; ``two_sample_distance`` needs no bins."""
    ends = [F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")]
    st = source.agg(*ends).first()
    if st["lo"] is None:
        st = other.agg(*ends).first()
    lo, hi = (0.0, 0.0) if st["lo"] is None else (st["lo"], st["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0

    def hist(df: DataFrame, name: str) -> DataFrame:
        b = F.least(F.greatest(F.floor((F.col(column).cast("double") - F.lit(lo)) / F.lit(width)),
                               F.lit(0)), F.lit(bins - 1)).cast("int")
        return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(
            F.count(F.lit(1)).alias(name))

    spark = source.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    h = grid.join(hist(source, "np"), "bin", "left").join(hist(other, "nq"), "bin", "left").fillna(0)
    from pyspark.sql import Window
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = Window.partitionBy(F.lit(1))
    # the bin table has ``bins`` rows: windows over it run on one task by design
    h = h.select("bin", "np", "nq", F.coalesce(F.try_divide(F.col("np"), F.sum("np").over(tot)), F.lit(0.0)).alias("p"),
                 F.coalesce(F.try_divide(F.col("nq"), F.sum("nq").over(tot)), F.lit(0.0)).alias("q"))
    h = h.select("*", F.sum("p").over(w).alias("cp"), F.sum("q").over(w).alias("cq"))
    eps = F.lit(1e-6)
    return h.agg(
        F.lit(column).alias("column_name"),
        _unless_empty(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, "np", "nq").alias("tvd"),
        _unless_empty(F.max(F.abs(F.col("cp") - F.col("cq"))), "np", "nq").alias("ks"),
        F.sum((F.greatest(F.col("q"), eps) - F.greatest(F.col("p"), eps))
              * F.log(F.greatest(F.col("q"), eps) / F.greatest(F.col("p"), eps))).alias("psi"))


# --- verbatim leakage -----------------------------------------------------------------------

def verbatim_leakage(source: DataFrame, other: DataFrame, columns: list[str],
                     other_columns: list[str] | None = None) -> DataFrame:
    """Rows of ``other`` whose value tuple on ``columns`` appears verbatim in ``source``.

    Both sides are reduced to distinct tuples (map-side combined) before a semi-join, so a
    value repeated a million times costs one join row; the leaked row count is summed back."""
    oc = other_columns or columns
    o = other.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(oc)])
    o = o.groupBy(*[f"k{i}" for i in range(len(oc))]).agg(F.count(F.lit(1)).alias("n"))
    s = source.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]).distinct()
    s = s.select(*[F.col(f"k{i}").alias(f"s{i}") for i in range(len(oc))])
    cond = F.col("n") > 0  # reads the aggregate: keeps the semi-join above it
    for i in range(len(oc)):
        cond = cond & (F.col(f"k{i}") == F.col(f"s{i}"))
    leaked = o.join(s, cond, "left_semi")
    return leaked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("leaked_rows"),
                      F.count(F.lit(1)).alias("leaked_values"))


# --- coverage -------------------------------------------------------------------------------

def pair_coverage(df: DataFrame, a: str, a_values: list, b: str, b_values: list) -> DataFrame:
    """Every declared (a, b) combination with its observed row count (0 = not covered).

    The declared combinations are a parameter-sized list built on the driver (|A|·|B| rows,
    never data-sized); observed counts come from one grouped aggregate."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(x, y) for x in a_values for y in b_values],
                                   T.StructType([T.StructField(a, df.schema[a].dataType),
                                                 T.StructField(b, df.schema[b].dataType)]))
    seen = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("rows"))
    return domain.join(seen, [a, b], "left").fillna(0, subset=["rows"])


def boundary_coverage(df: DataFrame, column: str, low, high) -> DataFrame:
    """Whether the boundary values of a range occur: rows at low, at high, and in between."""
    c = F.col(column)
    return df.agg(F.lit(column).alias("column_name"), F.count_if(c == F.lit(low)).alias("at_low"),
                  F.count_if(c == F.lit(high)).alias("at_high"),
                  F.count_if((c > F.lit(low)) & (c < F.lit(high))).alias("inside"))


def value_coverage(df: DataFrame, column: str, values: list) -> DataFrame:
    """Every declared value of ``column`` with its observed row count (0 = never produced);
    one grouped aggregate, the declared list is parameter-sized."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(v,) for v in values],
                                   T.StructType([T.StructField(column, df.schema[column].dataType)]))
    seen = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return domain.join(seen, column, "left").fillna(0, subset=["rows"])
