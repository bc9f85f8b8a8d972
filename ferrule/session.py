"""Session defaults shared by every job.

All jobs assume a UTC session time zone (timestamps with a zone are UTC wall time) and ANSI
mode (overflowing casts raise instead of wrapping).  AQE is on so shuffle partition counts and
skewed joins are re-planned at run time.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ferrule", extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` is only applied when given (a cluster submit sets it itself).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the session-level defaults on an existing session (driver-provided sessions)."""
    for key, value in _DEFAULTS.items():
        if key == "spark.sql.execution.arrow.pyspark.enabled":
            continue
        spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session leaves it unset and runs in one local process (tests) do we choose one
    ourselves; on a cluster a folder that only one machine sees would lose rows, so it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ferrule-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "ferrule", name)


def spread(df, cols: list[str] | None = None, min_partitions: int | None = None):
    """Repartition ``df`` only when it has fewer partitions than the session's parallelism.

    Used in front of per-row CPU-heavy work (generation over a scanned key spine, pattern scans,
    text rendering): a small table stored as one file is read as one partition, which would run
    that work on one core.  Large inputs already arrive in many splits and pass through
    unchanged.  With ``cols`` the shuffle hashes them (no sort needed for determinism)."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    # A plan with a shuffle already yields shuffle-partition-sized pieces; probing its RDD would
    # make adaptive execution run every shuffle stage right here, so only exchange-free plans
    # (scans and projections) are probed — for them the probe only lists the input splits.
    physical = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in physical or "AdaptiveSparkPlan" in physical:
        return df
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *cols) if cols else df.repartition(target)


def run_concurrently(tasks: list, max_workers: int = 8) -> list:
    """Run independent driver-side actions (callables that each trigger Spark jobs) from a
    thread pool, so small per-table jobs share the cluster instead of queueing one by one.
    Results come back in task order; the first failure is raised."""
    from concurrent.futures import ThreadPoolExecutor
    if len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=min(max_workers, len(tasks))) as pool:
        futures = [pool.submit(t) for t in tasks]
        return [f.result() for f in futures]


# Most shuffle partitions ever requested, and the fallback advisory size.
MAX_SHUFFLE_PARTITIONS = 100_000
ADVISORY_BYTES = 64 << 20


def path_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path`` (one metadata call to the file system)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(hpath).getLength())


def plan_bytes(df) -> int:
    """Catalyst's size estimate of a DataFrame (for a file scan: the listed file sizes, taken
    from the file index Spark built anyway — no extra listing)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def size_shuffles(spark: SparkSession, input_bytes: int) -> int:
    """Make sure shuffles over ``input_bytes`` of input start with enough partitions.

    AQE merges small shuffle partitions but never splits the initial ones, so the initial
    count must follow the data: ``input / advisory partition size``, never lowered (several
    inputs only raise it), capped at ``MAX_SHUFFLE_PARTITIONS``.  Returns the count in force."""
    conf = spark.conf
    base = int(conf.get("spark.sql.shuffle.partitions", "200"))
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    current = conf.get(key, None)
    current = int(current) if current else base
    advisory = conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    try:
        advisory_bytes = int(advisory) if advisory and advisory.isdigit() else ADVISORY_BYTES
    except ValueError:
        advisory_bytes = ADVISORY_BYTES
    wanted = min(MAX_SHUFFLE_PARTITIONS, max(current, -(-int(input_bytes) // advisory_bytes)))
    if wanted > current:
        conf.set(key, str(wanted))
    return wanted
