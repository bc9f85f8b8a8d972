"""Referentially consistent subsets of an existing table set (a sampling operator).

Root rows are chosen by a seeded counter draw on their integral key (``draw(key) < fraction``),
so the choice is reproducible and independent of partitioning.  Children are then pulled down
the FK edges and the parents of everything selected are pulled up, each step a left-semi join
against the (deduplicated) selected keys — no step collects keys on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draw import derive_seed, unit_cut, with_draws

Edge = tuple[str, str, str, str]  # (child table, child column, parent table, parent column)


def choose_roots(df: DataFrame, key: str, fraction: float, seed: int, label: str) -> DataFrame:
    picked = with_draws(df, key, {"__pick": derive_seed(seed, label, "__subset__", key)},
                        barrier=True)  # filtered on
    return picked.where(F.col("__pick") < F.lit(unit_cut(fraction)).cast("long")).drop("__pick")


def consistent_subset(tables: dict[str, DataFrame], root: str, root_key: str, fraction: float,
                      seed: int, down: list[Edge], up: list[Edge]) -> dict[str, DataFrame]:
    """``down`` edges (in order) select children of selected parents; ``up`` edges (in order,
    children before their parents) add the parents referenced by selected children."""
    sel: dict[str, DataFrame] = {root: choose_roots(tables[root], root_key, fraction, seed, root)}
    for child, ccol, parent, pcol in down:
        keys = sel[parent].select(F.col(pcol).alias("__k")).distinct()
        sel[child] = tables[child].join(keys, F.col(ccol) == F.col("__k"), "left_semi")
    for child, ccol, parent, pcol in up:
        keys = sel[child].select(F.col(ccol).alias("__k")).where(F.col("__k").isNotNull())
        if parent in sel:  # already selected rows of the parent stay selected
            keys = keys.unionByName(sel[parent].select(F.col(pcol).alias("__k")))
        sel[parent] = tables[parent].join(keys.distinct(), F.col(pcol) == F.col("__k"), "left_semi")
    return sel
