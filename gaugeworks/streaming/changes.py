"""Jobs over the change stream: alerts, and the current state of every aspect.

What a job writes is one Parquet table with a partition folder per micro-batch. A batch that
is repeated after a failure replaces its own folder, so a restart changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.operators.joins import BROADCAST_ROWS, HOT_ROWS, sized_join
from gaugeworks.operators.quality import FAILED

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCH = "batch"


def tier_alerts(
    changes: DataFrame,
    tiers: DataFrame,
    tier: str = "Tier1",
    *,
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Failed assertions on datasets of one tier, from a table or a micro-batch of changes.

    `changes` has entity and status, `tiers` has entity and tier.
    """
    watched = tiers.where(F.col("tier") == tier).select("entity").distinct()
    failed = changes.where(F.col("status") == FAILED)
    return sized_join(failed, watched, ["entity"], "inner", max_rows=max_rows, hot_rows=hot_rows)


def run_alerts_to_files(
    stream: DataFrame, tiers: DataFrame, path: str, checkpoint: str, tier: str = "Tier1", **sizes: int
) -> StreamingQuery:
    """Write the alerts of each micro-batch until the source is exhausted.

    Stateless. Each micro-batch measures the tier table and, where that is too large to
    broadcast, counts its own hot entities. The tier table's files are listed at the start:
    restart the query to see entities whose tier changed. Read with `read_batches`.
    """
    write = _batch_writer(path, lambda batch: tier_alerts(batch, tiers, tier, **sizes))
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def _batch_writer(
    path: str, made: Callable[[DataFrame], DataFrame] = lambda batch: batch
) -> Callable[[DataFrame, int], None]:
    """Writer of each micro-batch to its own partition folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return write


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches with their batch's number; empty before the first."""
    stored = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    try:
        return spark.read.schema(stored).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stored)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all batches; empty before the first."""
    return _batches(spark, path, schema).drop(BATCH)


def latest_state(changes: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Newest value per (urn, aspect); on a stream, kept up to date by each micro-batch.

    Every task merges its rows per key before the shuffle. Nothing expires: the state
    grows with the number of (urn, aspect) pairs; `run_state_to_files` keeps it off the heap.
    """
    order = F.struct(ts, seq)
    return changes.groupBy("urn", "aspect").agg(
        F.max_by(F.struct("value", ts, seq), order).alias("newest")
    ).select("urn", "aspect", "newest.*")


def run_state_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the keys that each micro-batch changed, with their new values.

    State goes to RocksDB unless the session names a state store of its own. Read with
    `read_state`.
    """
    conf = stream.sparkSession.conf
    chosen = conf.get(_STATE_STORE, None)
    writer = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(_batch_writer(path))
    )
    if chosen is not None:
        return writer.start()
    conf.set(_STATE_STORE, _ROCKSDB)  # read once, as the query starts
    try:
        return writer.start()
    finally:
        conf.unset(_STATE_STORE)


def read_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Current state: each key's row of its last batch; empty before the first batch.

    The aggregate merges inside the tasks, so a key that every batch changed is one row per
    task in the shuffle.
    """
    names = [c for c in schema.names if c not in ("urn", "aspect")]
    newest = F.max_by(F.struct(*names), F.col(BATCH)).alias("newest")
    return _batches(spark, path, schema).groupBy("urn", "aspect").agg(newest).select(
        "urn", "aspect", "newest.*"
    )
