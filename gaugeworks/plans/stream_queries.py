"""Registered queries: streams over events, run until the source is exhausted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.quality import FAILED, SUCCESS
from gaugeworks.plans.keyed_queries import LATEST_SQL
from gaugeworks.plans.quality_queries import VALUE_LIMIT
from gaugeworks.plans.standins import change_log_of, table
from gaugeworks.session import scratch_path
from gaugeworks.streaming import changes


BATCH_BYTES = 1024**4


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream of the events table, a single file or a folder of files.

    A stream takes a single file only through a pattern; this one fits no other name.

    Micro-batches are limited in size, so that a failure repeats one of them, not the run.
    """
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    return reader.option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{sf_dir}/events.parque[t]")


def q_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = event_stream(spark, sf_dir).select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity"),
        F.when(F.col("value") > VALUE_LIMIT, FAILED).otherwise(SUCCESS).alias("status"),
        F.col("event_type").alias("test"),
        F.col("event_id").alias("run_id"),
        "ts",
    )
    tiers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("entity"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Tier1")
        .otherwise("Tier3").alias("tier"),
    )
    out, progress = scratch_path(spark, "alerts"), scratch_path(spark, "alerts-progress")
    changes.run_alerts_to_files(runs, tiers, out, progress).awaitTermination()
    return changes.read_batches(spark, out, runs.schema)


def q_latest_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = changes.latest_state(change_log_of(event_stream(spark, sf_dir)))
    out = scratch_path(spark, "state")
    progress = scratch_path(spark, "state-progress")
    changes.run_state_to_files(state, out, progress).awaitTermination()
    return changes.read_state(spark, out, state.schema)


QUERIES = {
    "alert_stream": q_alert_stream,
    "latest_state_stream": q_latest_state_stream,
}

ORACLE = {
    "alert_stream": """SELECT 'user:' || CAST(user_id AS VARCHAR) AS entity, 'FAILED' AS status,
       event_type AS test, event_id AS run_id, ts
FROM events JOIN customer ON c_custkey = user_id
WHERE value > 150 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""",
    "latest_state_stream": f"SELECT urn, aspect, value, ts, seq FROM ({LATEST_SQL})",
}
