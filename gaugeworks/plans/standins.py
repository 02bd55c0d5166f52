"""Sensor, change-log and metadata tables derived from the given tables.

Everything is a projection of whole input tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import schemas

# Content of the zone lookup.
ZONES = [(20, "zone_a"), (21, "zone_b"), (22, "zone_c"), (23, "zone_d"), (24, "zone_e")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(kind: str, column: str) -> Column:
    """Entity key such as part:17."""
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def zone_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, schemas.ZONE_LOOKUP)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings from events: some null and empty keys, a hot sensor, stray metric values."""
    user, event = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(event % 200 == 0, F.lit(None))
        .when(event % 200 == 1, "")
        .when(user % 5 == 0, "sensor_hv")
        .otherwise(F.concat(F.lit("sensor_"), user.cast("string")))
        .alias("sensor_id"),
        (F.when(user % 25 == 1, 70.0).otherwise(0.0) + 18.0 + F.col("value") / 10.0)
        .alias("metric_1"),
        F.get_json_object("props", "$.k").cast("double").alias("metric_2"),
        F.col("ts").cast("string").alias("ts"),
    )


# The same rows for the checking engine.
READINGS_SQL = """readings AS (
  SELECT CASE WHEN event_id % 200 = 0 THEN NULL
              WHEN event_id % 200 = 1 THEN ''
              WHEN user_id % 5 = 0 THEN 'sensor_hv'
              ELSE concat('sensor_', CAST(user_id AS VARCHAR)) END AS sensor_id,
         CASE WHEN user_id % 25 = 1 THEN 70.0 ELSE 0.0 END + 18.0 + value / 10.0 AS metric_1,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS metric_2
  FROM events)"""

PROFILES_SQL = READINGS_SQL + """, profiles AS (
  SELECT sensor_id, AVG(metric_1) AS avg_metric_1, AVG(metric_2) AS avg_metric_2,
         COUNT(*) / 100.0 AS confidence
  FROM readings WHERE sensor_id IS NOT NULL AND sensor_id <> '' GROUP BY sensor_id)"""

ENRICHED_SQL = PROFILES_SQL + """, zones(bucket, zone_label) AS (
  VALUES (20, 'zone_a'), (21, 'zone_b'), (22, 'zone_c'), (23, 'zone_d'), (24, 'zone_e')),
enriched AS (
  SELECT sensor_id, avg_metric_1, avg_metric_2, COALESCE(zone_label, 'unknown') AS zone_label
  FROM profiles LEFT JOIN zones ON CAST(FLOOR(avg_metric_1) AS INTEGER) = bucket)"""


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspect log from events: one entity per user, one aspect per event type."""
    return change_log_of(table(spark, sf_dir, "events"))


def change_log_of(events: DataFrame) -> DataFrame:
    """Batch or streaming events as (urn, aspect, value, ts, seq, actor)."""
    return events.select(
        F.concat(F.lit("urn:li:corpuser:"), F.col("user_id").cast("string")).alias("urn"),
        F.col("event_type").alias("aspect"),
        F.col("props").alias("value"),
        "ts",
        F.col("event_id").alias("seq"),
        F.concat(F.lit("actor_"), (F.col("event_id") % 7).cast("string")).alias("actor"),
    )


CHANGE_LOG_SQL = """log AS (
  SELECT 'urn:li:corpuser:' || CAST(user_id AS VARCHAR) AS urn, event_type AS aspect,
         props AS value, ts, event_id AS seq,
         'actor_' || CAST(event_id % 7 AS VARCHAR) AS actor
  FROM events)"""
