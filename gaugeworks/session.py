"""Session defaults and the shared folders jobs may write intermediate data to."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Fewer, larger scan tasks; a small table is still cut for all cores.
    "spark.sql.files.maxPartitionBytes": "512m",
}
_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def open_session(app_name: str) -> SparkSession:
    """Session for a submitted job. Master and memory come from spark-submit.

    Shuffles start with four partitions per core, which adaptive execution merges where
    they turn out small; it cannot cut those that turn out large.
    """
    spark = SparkSession.builder.appName(app_name).getOrCreate()
    named = spark.conf.getAll
    for key, value in _DEFAULTS.items():
        if key not in named:
            spark.conf.set(key, value)
    if spark.conf.get(_INITIAL_PARTITIONS, None) is None:
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set(_INITIAL_PARTITIONS, str(max(200, 4 * cores)))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in spark.checkpoint.dir.

    A local session without the setting gets a temporary folder; on a cluster a
    machine-local folder would lose data, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(application: str) -> str:
    """One temporary folder per local application."""
    return tempfile.mkdtemp(prefix=f"gaugeworks-{application}-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder; nothing is ever overwritten by it."""
    return f"{shared_dir(spark)}/gaugeworks/{label}-{uuid.uuid4().hex}"


def settle_measured(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
    """`settle`, with aggregates over the rows taken by the write itself."""
    seen = Observation()
    settled = settle(df.observe(seen, *[c.alias(name) for name, c in aggregates.items()]))
    return settled, seen.get


def settle(df: DataFrame) -> DataFrame:
    """Compute once: write the rows to the shared folder and read them back.

    Cuts the lineage like a checkpoint, in one job; a lost executor cannot take the rows
    away, and later plans see the table's real size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
