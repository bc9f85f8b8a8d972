"""Chunked generation: a table as the union of row-range slices.

Draws depend only on the global row index, so slice [offset, offset+k) of a table equals the
same rows of a one-shot build.  ``chunked_table`` is one plan over all slices.
``generate_in_chunks`` writes the slices that a run before has not completed, each to its own
sub-directory, by one job, and then marks them with an empty ``_CHUNK_DONE`` file; slices without
the mark are written again.  The result directory is readable as one Parquet table.
"""

from __future__ import annotations

import hashlib
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generate import generate_table
from ..plans.spec import TableSpec

DONE = "_CHUNK_DONE"


def _done(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def _mark(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(hpath, True).close()


def _slices(spark: SparkSession, table: TableSpec, seed: int, n: int, chunk_rows: int, unique: bool,
            numbers: list[int]) -> DataFrame:
    """The slices ``numbers`` as one plan, with their number as text in ``chunk``."""
    return reduce(DataFrame.unionByName, [
        generate_table(spark, table, seed, n=min(chunk_rows, n - i * chunk_rows), offset=i * chunk_rows, unique=unique)
        .withColumn("chunk", F.lit(f"{i:06d}")) for i in numbers])


def chunked_table(spark: SparkSession, table: TableSpec, seed: int, n: int, chunk_rows: int) -> DataFrame:
    """Rows 0..n-1 of ``table`` as one plan over its slices."""
    if chunk_rows <= 0:
        raise ValueError("chunk_rows must be positive")
    numbers = list(range(-(-n // chunk_rows))) or [0]
    return _slices(spark, table, seed, n, chunk_rows, False, numbers).drop("chunk")


def generate_in_chunks(spark: SparkSession, table: TableSpec, seed: int, n: int, chunk_rows: int,
                       path: str, unique: bool = False) -> list[str]:
    """Write rows 0..n-1 of ``table`` under ``path/run=<digest>/chunk=<i>``; returns the chunk
    directories.  The digest is of everything asked for, so a chunk is only taken over from a run
    that asked for the same.

    ``unique`` re-checks PK/UNIQUE columns per chunk only; a whole-table check belongs after
    the last chunk (``check_unique`` on the read-back table)."""
    if chunk_rows <= 0:
        raise ValueError("chunk_rows must be positive")
    asked = repr((table, seed, n, chunk_rows, unique)).encode("utf-8")
    path = os.path.join(path, "run=" + hashlib.blake2b(asked, digest_size=8).hexdigest())
    out = [os.path.join(path, f"chunk={i:06d}") for i in range(-(-n // chunk_rows))]
    left = [i for i, target in enumerate(out) if not _done(spark, os.path.join(target, DONE))]
    if left:
        (_slices(spark, table, seed, n, chunk_rows, unique, left).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path))
    for i in left:
        _mark(spark, os.path.join(out[i], DONE))
    return out


def read_chunks(spark: SparkSession, chunks: list[str]) -> DataFrame:
    """The chunks that ``generate_in_chunks`` returned, as one table."""
    return spark.read.parquet(*chunks)
