"""Helpers shared by the training-data operators.

Every operator starts with a projection onto the few columns it reads, so extra columns of its
input, whatever their names, never meet the operator's own columns.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.session import checkpoint_dir


BATCH = 4 << 20  # bytes of an Arrow batch


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, so that the functions of
    Python operators can be imported there, and bound the batches that tasks exchange with Python
    workers by bytes, so that long texts come fewer at a time."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    name = f"ferrule_{sc.applicationId.replace('-', '_')}.zip"
    if any(os.path.basename(p) == name for p in sc._python_includes):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ferrule-code-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a lost executor
    costs a re-read instead of a recomputation.  The shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/ferrule-llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return to the system what this Python worker has freed: workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # another C library
        pass


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def bounded_sample(df: DataFrame, by: Column, per_class: int, counts: dict) -> DataFrame:
    """Rows kept by a hash of their text so that about ``per_class`` rows of each class remain:
    a fraction per class, computed from the exact class ``counts``; no sort, no window."""
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_class / max(n, 1))))])
    u = F.pmod(F.xxhash64(F.col("text"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    return df.where(u < share[by])


def keep_once(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose (doc_id, hash of the text) are in ``keep``
    (columns doc_id, h; a row per row kept); of rows that agree in both, one."""
    keys = keep.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    keys = stored(keys.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("n").alias("__n")), "kept-keys")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty()) == F.col("__h"))
    once = docs.join(keys.where("__n = 1"), same, "left_semi")
    again = keys.where("__n > 1")
    if again.isEmpty():
        return once
    rest = docs.join(again, same).dropDuplicates(["__id", "__h"])
    return once.unionByName(rest.select(docs.columns))
