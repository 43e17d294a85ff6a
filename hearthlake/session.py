"""Session set-up and lineage cutting."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Runtime re-planning is what picks join sides and splits skewed partitions from measured sizes.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "hearthlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators were planned for; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory used by `checkpoint()`: the cluster's own setting, a temp folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="hearthlake-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and read it back, so later reads agree."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_unreachable(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files, and the checkpoints if it may, of data frames that nothing refers to any more.

    It learns of them only when the driver's heap is collected, which a job of few small results on the driver never brings about.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of a split below which it may hold no row group of its file, or all of them.
SPLIT_BYTES = 32 << 20


def spread_small_scan(df: DataFrame) -> DataFrame:
    """Spread the rows of a plain scan over all cores where its splits may not.

    Splits are cut by bytes, but a row group of a Parquet file is read whole by one of them: a file of few row groups has most
    of its rows in few tasks, however many splits it has. A scan with fewer splits than cores, or with splits below SPLIT_BYTES on
    average, is dealt out, in up to four tasks a core; a table with larger splits comes back as it is, without a shuffle. Meant
    for scans: asking a plan with shuffles for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if splits >= cores and size >= splits * SPLIT_BYTES:
        return df
    return df.repartition(max(cores, min(4 * cores, size >> 20)))


def pack_small_splits(df: DataFrame) -> DataFrame:
    """Deal the splits of a plain scan over tasks that take several each, where they are many and small.

    Without a shuffle: a task reads its splits one after another, whole and in order. There are four tasks a core, or one for each
    SPLIT_BYTES where that is more; a scan of no more splits comes back as it is.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, size // SPLIT_BYTES)
    return df.coalesce(tasks) if df.rdd.getNumPartitions() > tasks else df
