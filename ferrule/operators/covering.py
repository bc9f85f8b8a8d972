"""Generation towards coverage: the first rows hold every pair of declared values, the rest is drawn.

The domains are what the spec declares: the values of a categorical column (those of weight 0 left
out), true and false, and the two ends of a range.  ``covering_rows`` is a greedy pairwise
covering array over them: a row starts from a pair that is still missing, and every further column
takes the value that covers most missing pairs with the columns chosen already.  Its size follows
the declared domains, never the data; it is laid over the first rows of the spine by position.
Key, unique and foreign-key columns keep their own values, so their rules hold as ever.
"""

from __future__ import annotations

from itertools import combinations
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import SpecError, TableSpec
from .generate import ROW, generate_table

RANGES = ("int_range", "decimal_range", "date_range", "timestamp_range")


def domains(table: TableSpec) -> dict[str, list[Any]]:
    """The declared values by column, in declared order."""
    out: dict[str, list[Any]] = {}
    for c in table.columns:
        if c.generator is None or c.name in table.unique_columns or c.name in table.fk_columns:
            continue
        p = c.generator.params
        if c.generator.kind == "categorical":
            weights = p.get("weights") or [1] * len(p["values"])
            values = [v for v, w in zip(p["values"], weights) if w > 0]
        elif c.generator.kind in RANGES:
            values = [p["low"], p["high"]]
        else:
            continue
        out[c.name] = list(dict.fromkeys(values))
    return out


def covering_rows(values: dict[str, list[Any]]) -> list[dict[str, Any]]:
    """Rows over all columns in which every pair of values of two columns stands together (every value,
    if there is one column only)."""
    names = sorted(values, key=lambda n: -len(values[n]))  # large domains first: fewer rows
    if len(names) < 2:
        return [{n: v} for n in names for v in values[n]]
    missing = {(a, i, b, j) for a, b in combinations(range(len(names)), 2)
               for i in range(len(values[names[a]])) for j in range(len(values[names[b]]))}
    rows = []
    for pair in sorted(missing):
        if pair not in missing:
            continue
        a, i, b, j = pair
        row = {a: i, b: j}

        def gained(col: int, v: int) -> int:
            return sum(((c, w, col, v) if c < col else (col, v, c, w)) in missing for c, w in row.items())

        for col in range(len(names)):
            if col not in row:
                row[col] = max(range(len(values[names[col]])), key=lambda v: (gained(col, v), -v))
        missing -= {(c, row[c], d, row[d]) for c, d in combinations(range(len(names)), 2)}
        rows.append({names[c]: values[names[c]][v] for c, v in row.items()})
    return rows


def generate_covering(spark: SparkSession, table: TableSpec, seed: int, n: int | None = None, unique: bool = True) -> DataFrame:
    """``n`` rows of ``table`` (default: its row count) whose first ones cover all pairs of ``domains``."""
    rows = covering_rows(domains(table))
    n = table.row_count if n is None else n
    if n is None or n < len(rows):
        raise SpecError("COVERAGE_ROWS", f"{table.name}: covering all pairs takes {len(rows)} rows, not {n}")
    df = generate_table(spark, table, seed, n, unique=unique, keep_row=True)
    if not rows:
        return df.drop(ROW)
    columns = []
    for c in table.columns:
        if c.name in rows[0]:
            kind = c.type.spark_type()
            given = F.element_at(F.array(*[F.lit(str(r[c.name]).lower() if isinstance(r[c.name], bool) else str(r[c.name])) for r in rows]),
                                 (F.col(ROW) + 1).cast("int")).cast(kind)
            columns.append(F.when(F.col(ROW) < len(rows), given).otherwise(F.col(c.name)).alias(c.name))
        else:
            columns.append(F.col(c.name))
    return df.select(*columns)
