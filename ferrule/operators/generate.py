"""Seeded table and dataset generation as lazy DataFrame plans.

Single table: ``spark.range`` spine (``__row`` = global row index) → draw columns (counter-based,
one independent stream per column) → typed value columns in declared order.  No shuffle, no
driver data; the plan is one whole-stage-codegen span per partition.

Dataset: tables in FK order.  The first FK into another generated table *drives* the child:
each parent key is repeated k ∈ [min, max] times (k drawn per parent row) with dense child row
numbers from a two-level prefix sum.  Other FKs sample the parent's key pool uniformly with
replacement: a serial key is pure arithmetic (no join); any other key joins on the pool's dense
index.  Reference tables supply pools from stored keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draw import derive_seed, with_draws
from ..functions.generators import REGISTRY, GenContext, _draw63, _span_draws, null_mask, uniform_below
from ..session import spread
from ..plans.spec import DatasetSpec, ForeignKeySpec, SpecError, TableSpec, build_order, driving_fk, filled_later
from .expand import dense_index, expand_by_counts

ROW = "__row"
# Fixed values of the plan shape: target bytes of generated output per spine slice, and the
# estimated bytes per value of each canonical kind (text kinds by their typical length).
PARTITION_BYTES = 128 << 20
MIN_SLICE_ROWS = 100_000
KIND_BYTES = {"BOOLEAN": 1, "INT16": 2, "INT32": 4, "INT64": 8, "FLOAT32": 4, "FLOAT64": 8,
              "DECIMAL": 16, "DATE": 4, "TIME": 8, "TIMESTAMP": 8, "UUID": 36, "JSON": 32,
              "STRING": 32, "BYTES": 32}


def row_bytes(table: TableSpec) -> int:
    """Estimated bytes of one generated row (sizes the spine's slices)."""
    return max(8, sum(KIND_BYTES.get(c.type.kind, 16) for c in table.columns))


class UniquenessError(ValueError):
    """A PK/UNIQUE column received duplicate values."""


def spine(spark: SparkSession, n: int, offset: int = 0, parts: int | None = None,
          bytes_per_row: int = 64) -> DataFrame:
    """Rows ``offset .. offset+n-1`` as ``__row``; values never depend on ``parts``, which by
    default gives every core a slice and keeps each slice near ``PARTITION_BYTES`` of output."""
    if n < 0:
        raise ValueError("row count must be ≥ 0")
    if parts is None:
        # every core gets a slice once there are enough rows to share (≥ MIN_SLICE_ROWS each);
        # beyond that, slices are sized by output bytes
        by_rows = min(spark.sparkContext.defaultParallelism, math.ceil(n / MIN_SLICE_ROWS))
        parts = max(1, by_rows, math.ceil(n * bytes_per_row / PARTITION_BYTES))
    return spark.range(offset, offset + n, 1, parts).withColumnRenamed("id", ROW)


def _draw_seeds(seed: int, table: str, column: str, n: int, purpose: str | None = None) -> list[int]:
    """Sub-seeds of a column's ``n`` draws (for a purpose other than its values, named first)."""
    path = (table, column) if purpose is None else (table, purpose, column)
    return [derive_seed(seed, *path, *([f"__draw{k}__"] if k else [])) for k in range(n)]


def generate_columns(base: DataFrame, table: TableSpec, seed: int,
                     fk_values: dict[str, Column] | None = None, keep: list[str] | None = None,
                     partitioned: bool = False, barrier: bool = False) -> DataFrame:
    """Value columns of ``table`` for every row of ``base`` (which carries ``__row``).

    ``partitioned``: ``base`` is already split for the cluster (a ``spine``), so the
    under-partitioning probe is skipped.  ``barrier``: emit the row through a one-row
    ``inline`` so filters applied later (without storing the table first) stop at the finished
    values instead of re-inlining the draw rounds; costs some generation throughput."""
    fk_values = fk_values or {}
    draws: dict[str, int] = {}
    plan: list[tuple[Any, list[str], str | None]] = []
    for ci, col in enumerate(table.columns):
        if col.name in fk_values:
            plan.append((col, [], None))
            continue
        gen = REGISTRY[col.generator.kind]
        names = [f"__d{ci}_{k}" for k in range(gen.n_draws(col.generator.params))]
        for name, s in zip(names, _draw_seeds(seed, table.name, col.name, len(names)), strict=True):
            draws[name] = s
        null_name = None
        if table.is_nullable(col) and col.null_rate > 0.0:
            null_name = f"__n{ci}"
            draws[null_name] = derive_seed(seed, table.name, col.name, "__nulls__")
        plan.append((col, names, null_name))
    df = with_draws(base if partitioned else spread(base, [ROW]), ROW, draws)
    out: list[Column] = [F.col(k) for k in (keep or [])]
    for col, names, null_name in plan:
        stype = col.type.spark_type()
        if col.name in fk_values:
            value = fk_values[col.name]
        else:
            ctx = GenContext([F.col(n) for n in names], F.col(ROW), col.type)
            value = REGISTRY[col.generator.kind].build(col.generator.params, ctx)
        value = value.cast(stype)
        if null_name is not None:
            value = F.when(null_mask(F.col(null_name), col.null_rate), F.lit(None).cast(stype)) \
                .otherwise(value)
        out.append(value.alias(col.name))
    if barrier:
        return df.select(F.inline(F.array(F.struct(*out))))
    return df.select(*out)


def unique_violations(df: DataFrame, table: TableSpec) -> DataFrame:
    """(column_name, repeated_values, surplus_rows) of every PK/UNIQUE column, also of those without
    a violation: one aggregation a column, map-side combined."""
    parts = []
    for name in sorted(table.unique_columns):
        per_value = df.groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        bad = F.col("v").isNotNull() & (F.col("n") > 1)
        parts.append(per_value.agg(F.lit(name).alias("column_name"), F.count_if(bad).alias("repeated_values"),
                                   F.coalesce(F.sum(F.when(bad, F.col("n") - 1)), F.lit(0)).alias("surplus_rows")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column_name string, repeated_values long, surplus_rows long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def check_unique(df: DataFrame, table: TableSpec, skip: set[str] | None = None) -> None:
    """Raise ``UniquenessError`` when a PK/UNIQUE column has a repeated non-null value.

    Serial columns are unique by construction and FK columns are exempt; every other unique
    column costs one aggregation (map-side combined).  ``unique_violations`` returns all counts."""
    skip = set(skip or ()) | table.fk_columns
    for name in sorted(table.unique_columns):
        col = table.column(name)
        if name in skip or (col.generator is not None and col.generator.kind == "serial"):
            continue
        # group first, then drop the one NULL group on the driver: a filter on the freshly
        # generated column would be pushed into (and re-inline) its draw projections
        groups = df.groupBy(name).count().where(F.col("count") > 1).limit(2).collect()
        dup = [g for g in groups if g[0] is not None]
        if dup:
            raise UniquenessError(
                f"{table.name}.{name} requires unique values but the generator produced duplicates "
                f"(e.g. {dup[0][0]!r}); widen the value domain or use a serial generator")


def generate_table(spark: SparkSession, table: TableSpec, seed: int, n: int | None = None,
                   offset: int = 0, parts: int | None = None, unique: bool = True,
                   keep_row: bool = False, barrier: bool = False) -> DataFrame:
    """Rows [offset, offset+n) of one table without FKs (or with FKs filled by the caller)."""
    rows = n if n is not None else table.row_count
    if rows is None:
        raise SpecError("ROWCOUNT_MISSING", f"table {table.name!r} has no row_count and no n")
    df = generate_columns(spine(spark, rows, offset, parts, row_bytes(table)), table, seed,
                          keep=[ROW] if keep_row else None, partitioned=True, barrier=barrier)
    if unique:
        check_unique(df, table)
    return df


# --- datasets -------------------------------------------------------------------------------

@dataclass
class KeyPool:
    """Keys a child may reference: ``serial_start`` set → key = start + index (no join);
    else ``frame`` holds (``__row`` dense index, ``key``)."""
    size: int
    serial_start: int | None = None
    frame: DataFrame | None = None

    def lookup(self, child: DataFrame, index: Column, out: str) -> DataFrame:
        if self.serial_start is not None:
            return child.withColumn(out, F.lit(self.serial_start).cast("long") + index)
        pool = self.frame.select(F.col(ROW).alias("__pidx"), F.col("key").alias(out))
        return child.withColumn("__pidx", index).join(pool, "__pidx", "left").drop("__pidx")


def reference_pool(keys: DataFrame, column: str | None = None) -> KeyPool:
    """A pool from an existing table's key column (nulls dropped, repeats removed)."""
    column = column or keys.columns[0]
    idx, m = dense_index(keys, column)
    return KeyPool(size=m, frame=idx.select(ROW, F.col(column).alias("key")))


def _table_pool(df: DataFrame, table: TableSpec, n: int) -> KeyPool | None:
    if not table.primary_key:
        return None
    key = table.column(table.primary_key[0])
    if key.generator is not None and key.generator.kind == "serial" and key.name not in table.fk_columns:
        return KeyPool(size=n, serial_start=int(key.generator.params.get("start", 1)))
    return KeyPool(size=n, frame=df.select(ROW, F.col(key.name).alias("key")))


def _parent_rows(pool: KeyPool, spark: SparkSession) -> DataFrame:
    """(``__prow``, ``__pkey``) for every key of a pool."""
    if pool.serial_start is not None:
        return (spine(spark, pool.size).withColumnRenamed(ROW, "__prow")
                .withColumn("__pkey", F.lit(pool.serial_start).cast("long") + F.col("__prow")))
    return pool.frame.select(F.col(ROW).alias("__prow"), F.col("key").alias("__pkey"))


def _child_counts(prow: DataFrame, seed: int, child: str, column: str, lo: int, hi: int) -> DataFrame:
    """(``__prow``, ``__pkey``, ``__k``): k ∈ [lo, hi] children drawn per parent row index."""
    span = hi - lo + 1
    n_k = _span_draws(span)
    kdraws = {f"__k{j}": derive_seed(seed, child, "__cardinality__", column) if j == 0 else
              derive_seed(seed, child, "__cardinality__", column, f"__draw{j}__") for j in range(n_k)}
    prow = with_draws(prow.withColumn(ROW, F.col("__prow")), ROW, kdraws)
    return prow.select("__prow", "__pkey", (F.lit(lo).cast("long")
                       + uniform_below([F.col(k) for k in kdraws], span)).alias("__k"))


def _observed_counts(prow: DataFrame, seed: int, child: str, fk: ForeignKeySpec, size: int) -> DataFrame:
    """(``__prow``, ``__pkey``, ``__k``) after a histogram of children per parent.

    The ``size`` parents are put into another order (i -> (a i + b) mod size, a coprime to size), and
    the place of a parent among them, scaled to the observed number of parents, lies between two cut
    points of the histogram.  So as many parents have k children as were observed (in proportion, if
    there are more or fewer parents), and a hot parent comes exactly as often as in the source."""
    spark, observed = prow.sparkSession, sum(n for _, n in fk.child_counts)
    a = derive_seed(seed, child, "__cardinality__", fk.column) % max(1, size) or 1
    while math.gcd(a, size) != 1:
        a += 1
    b = derive_seed(seed, child, "__cardinality__", fk.column, "__shift__") % max(1, size)
    whole = "long" if size < 1 << 31 and observed < 1 << 31 else "decimal(19,0)"
    place = (F.lit(a).cast(whole) * F.col("__prow").cast(whole) + F.lit(b).cast(whole)) % F.lit(max(1, size)).cast(whole)
    rank = place.cast("long")
    if size != observed:
        rank = F.floor(rank.cast(whole) * F.lit(observed).cast(whole) / F.lit(size).cast("decimal(19,0)")).cast("long")
    cuts, at = [], 0
    for k, n in sorted(fk.child_counts):
        cuts.append((k, at, at + n))
        at += n
    step = max(1, -(-observed // (1 << 16)))
    table = spark.createDataFrame(cuts, "__k long, __lo long, __hi long").withColumn(
        "__b", F.explode(F.sequence(F.expr(f"__lo div {step}"), F.expr(f"(__hi - 1) div {step}"))))
    rows = prow.withColumn("__rank", rank).withColumn("__b", F.expr(f"__rank div {step}"))
    return rows.join(table, "__b").where("__rank >= __lo AND __rank < __hi").select("__prow", "__pkey", "__k")


def _counts_of(prow: DataFrame, seed: int, child: str, fk: ForeignKeySpec, size: int) -> DataFrame:
    if fk.child_counts:
        return _observed_counts(prow, seed, child, fk, size)
    return _child_counts(prow, seed, child, fk.column, fk.min_per_parent, fk.max_per_parent)


def _expand(prow: DataFrame, size: int, seed: int, child: str, column: str, lo: int, hi: int,
            child_counts: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """Children of (``__prow``, ``__pkey``) parents, dense child row numbers in parent order."""
    counts = _counts_of(prow, seed, child, ForeignKeySpec(column, "", "", lo, hi, child_counts), size)
    return expand_by_counts(counts, "__prow", "__k", key_range=max(1, size), max_count=hi)


def expand_parent(parent: DataFrame, key: str, min_per_parent: int, max_per_parent: int,
                  seed: int, child: str, column: str) -> DataFrame:
    """Child rows of an existing parent table: each distinct non-null ``key`` (in key order)
    repeated k ∈ [min, max] times → (``__row`` dense child index, ``column`` = parent key)."""
    pool = reference_pool(parent.select(key), key)
    out = _expand(_parent_rows(pool, parent.sparkSession), pool.size, seed, child, column,
                  min_per_parent, max_per_parent)
    return out.select(ROW, F.col("__pkey").alias(column))


def sample_keys(child: DataFrame, index_col: str, pool: KeyPool, seed: int, table: str,
                column: str, out: str) -> DataFrame:
    """Add ``out``: a key drawn uniformly (with replacement) from ``pool`` per child row, the
    draw indexed by ``index_col``.  Serial pools are arithmetic; others join on the dense index
    (the child side is uniform over the index by construction, so the join has no hot key)."""
    if pool.size == 0:
        raise SpecError("FK_UNRESOLVED", f"{table}.{column}: the key pool is empty")
    names = [f"__s0_{column}", f"__s1_{column}"]  # 63 bits: every key of any pool can be drawn
    seeds = _draw_seeds(seed, table, column, 2, "__fk_sample__")
    child = with_draws(child, index_col, dict(zip(names, seeds)),
                       barrier=True)  # joined on: keep the join's null filter off the mixer
    index = _draw63(*map(F.col, names)) % F.lit(pool.size).cast("long")
    return pool.lookup(child, index, out).drop(*names)


def self_reference(base: DataFrame, table: TableSpec, seed: int, column: str, out: str) -> DataFrame:
    """Self-referencing FK: row i > 0 points at a uniformly drawn earlier row j < i (so the
    references form a forest rooted at row 0, whose value is NULL).  Needs a serial first PK
    column, which makes the parent's key plain arithmetic on j (no join)."""
    key = table.column(table.primary_key[0]) if table.primary_key else None
    if key is None or key.generator is None or key.generator.kind != "serial":
        raise SpecError("SELF_FK_UNSUPPORTED",
                        f"{table.name}.{column}: a self reference needs a serial primary key")
    start = int(key.generator.params.get("start", 1))
    names = [f"__sf0_{column}", f"__sf1_{column}"]
    base = with_draws(base, ROW, dict(zip(names, _draw_seeds(seed, table.name, column, 2, "__self_fk__"))))
    value = F.when(F.col(ROW) == 0, F.lit(None).cast("long")).otherwise(
        F.lit(start).cast("long") + _draw63(*map(F.col, names)) % F.col(ROW))
    return base.withColumn(out, value).drop(*names)


def materialize(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` (Parquet, shared storage) and return the stored table."""
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def generate_dataset(spark: SparkSession, spec: DatasetSpec, row_counts: dict[str, int] | None = None,
                     reference_pools: dict[str, DataFrame | KeyPool] | None = None,
                     parts: int | None = None, unique: bool = True,
                     keep_row: bool = False, materialize_dir: str | None = None,
                     barrier: bool = False) -> dict[str, DataFrame]:
    """Every generated table of ``spec`` as a lazy DataFrame (parents first).

    With ``materialize_dir`` (a folder in shared storage) every table is written there as soon
    as it is planned and read back: children, pools, uniqueness checks and later data tests then
    read stored rows instead of recomputing the parent's generation, and the lineage is cut.

    ``row_counts`` overrides the declared count of tables without a driving FK; children of a
    driving FK get Σk rows.  ``reference_pools`` supplies keys for REFERENCE tables, either as
    a DataFrame whose first column holds the keys or as a prepared ``KeyPool``.
    """
    row_counts = row_counts or {}
    seed = spec.seed
    generated = {t.name for t in spec.generated}
    pools: dict[str, KeyPool] = {}
    for name, p in (reference_pools or {}).items():
        pools[name] = p if isinstance(p, KeyPool) else reference_pool(p)
    referenced = {fk.ref_table for t in spec.generated for fk in t.foreign_keys}
    later = filled_later(spec)
    out: dict[str, DataFrame] = {}
    for name in build_order(spec):
        t = spec.table(name)
        drv = driving_fk(t, generated, later)
        fk_values: dict[str, Column] = {}
        if drv is not None:
            parent = pools.get(drv.ref_table)
            if parent is None:
                raise SpecError("FK_UNRESOLVED", f"{name}.{drv.column}: parent has no key pool")
            base = _expand(_parent_rows(parent, spark), parent.size, seed, name, drv.column,
                           drv.min_per_parent, drv.max_per_parent, drv.child_counts)
            base = base.select(ROW, F.col("__pkey").alias(f"__fk_{drv.column}"))
            fk_values[drv.column] = F.col(f"__fk_{drv.column}")
            n = None
        else:
            n = row_counts.get(name, t.row_count)
            if n is None:
                raise SpecError("ROWCOUNT_MISSING", f"table {name!r} has no driving FK and no row_count")
            base = spine(spark, n, 0, parts, row_bytes(t))
        for fk in t.foreign_keys:
            if fk is drv:
                continue
            if (name, fk.column) in later:  # filled when its parent is there
                fk_values[fk.column] = F.lit(None)
                continue
            if fk.ref_table == name:
                base = self_reference(base, t, seed, fk.column, f"__fk_{fk.column}")
                fk_values[fk.column] = F.col(f"__fk_{fk.column}")
                continue
            pool = pools.get(fk.ref_table)
            if pool is None:
                raise SpecError("FK_UNRESOLVED", f"{name}.{fk.column} references {fk.ref_table!r} "
                                "but no key pool is available (supply reference_pools)")
            if pool.size == 0:
                raise SpecError("FK_UNRESOLVED", f"{name}.{fk.column}: the key pool of "
                                f"{fk.ref_table!r} is empty")
            base = sample_keys(base, ROW, pool, seed, name, fk.column, f"__fk_{fk.column}")
            fk_values[fk.column] = F.col(f"__fk_{fk.column}")
        # bases here are spines or shuffle outputs: already split, no partition probe needed
        df = generate_columns(base, t, seed, fk_values, keep=[ROW], partitioned=True,
                              barrier=barrier and not materialize_dir)
        open_keys = any(table == name for table, _ in later)
        if materialize_dir:
            df = materialize(spark, df, f"{materialize_dir}/{name}{'__first' if open_keys else ''}")
        if unique:
            check_unique(df, t)
        if t.primary_key and name in referenced:
            # a driven child's size is Σk over its parents: a parent-level sum, no explode
            size = n if n is not None else _counts_of(
                _parent_rows(pools[drv.ref_table], spark), seed, name, drv, pools[drv.ref_table].size).agg(F.sum("__k")).first()[0] or 0
            pool = _table_pool(df, t, size)
            if pool is not None:
                pools[name] = pool
        out[name] = df if keep_row or open_keys else df.drop(ROW)
    for name in dict.fromkeys(table for table, _ in sorted(later)):
        t, df = spec.table(name), out[name]
        for fk in t.foreign_keys:
            if (name, fk.column) in later:
                if fk.ref_table not in pools or pools[fk.ref_table].size == 0:
                    raise SpecError("FK_UNRESOLVED", f"{name}.{fk.column}: {fk.ref_table!r} has no keys")
                filled = sample_keys(df.drop(fk.column), ROW, pools[fk.ref_table], seed, name, fk.column, "__later")
                df = filled.withColumn(fk.column, F.col("__later").cast(t.column(fk.column).type.spark_type()))
        df = df.select(ROW, *[c.name for c in t.columns])
        if materialize_dir:
            df = materialize(spark, df, f"{materialize_dir}/{name}")
        out[name] = df if keep_row else df.drop(ROW)
    return out


def sample_dataset(spark: SparkSession, spec: DatasetSpec, sample_rows: int = 200,
                   reference_pools: dict[str, DataFrame | KeyPool] | None = None,
                   materialize_dir: str | None = None) -> dict[str, DataFrame]:
    """Small run: tables without a driving FK cut to ``sample_rows``; children derived.
    Because draws are counter-based, a root table of the sample is a prefix of the full run."""
    generated = {t.name for t in spec.generated}
    later = filled_later(spec)
    counts = {t.name: sample_rows for t in spec.generated if driving_fk(t, generated, later) is None}
    return generate_dataset(spark, spec, row_counts=counts, reference_pools=reference_pools,
                            materialize_dir=materialize_dir)


def preview(df: DataFrame, order_by: list[str], rows: int = 20) -> DataFrame:
    """First ``rows`` rows in key order (a top-k; each task keeps only its own top rows)."""
    return df.orderBy(*order_by).limit(rows)
