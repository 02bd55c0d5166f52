"""Registered queries: typed files, the sensor jobs and their single steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks import schemas
from gaugeworks.functions.scalars import floor_bucket, share_of
from gaugeworks.operators import sensors
from gaugeworks.operators.conform import conform_schema
from gaugeworks.plans import jobs
from gaugeworks.plans.standins import (
    ENRICHED_SQL, PROFILES_SQL, READINGS_SQL, readings, table, zone_lookup,
)
from gaugeworks.session import scratch_path
from gaugeworks.sources.files import read_csv_typed, read_parquet, write_parquet_overwrite

ORDER_SLIP = T.StructType([
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_orderpriority", T.StringType()),
])


def _rounded(df: DataFrame) -> DataFrame:
    """Averages to nine digits: engines add doubles in different orders."""
    return df.select([
        F.round(c, 9).alias(c) if c.startswith("avg_") else F.col(c) for c in df.columns
    ])


def _csv(spark: SparkSession, df: DataFrame, label: str) -> str:
    path = scratch_path(spark, label)
    df.write.option("header", True).csv(path)
    return path


def _readings_csv(spark: SparkSession, sf_dir: str) -> str:
    return _csv(spark, readings(spark, sf_dir), "readings")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors.sensor_profiles(readings(spark, sf_dir))


def _profiles_path(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "profiles")
    write_parquet_overwrite(_profiles(spark, sf_dir), path)
    return path


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors.zoned_profiles(_profiles(spark, sf_dir), zone_lookup(spark))


def q_read_csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv(spark, table(spark, sf_dir, "orders"), "orders")
    return read_csv_typed(spark, path, ORDER_SLIP)


def q_read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _profiles_path(spark, sf_dir)
    return _rounded(read_parquet(spark, path, schemas.SENSOR_PROFILE))


def q_write_parquet_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "overwritten")
    write_parquet_overwrite(table(spark, sf_dir, "supplier"), path)
    write_parquet_overwrite(table(spark, sf_dir, "customer"), path)
    return read_parquet(spark, path)


def q_filter_present_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sensors.filter_present_key(readings(spark, sf_dir), "sensor_id")
    return kept.select("sensor_id", F.round("metric_1", 6).alias("metric_1"), "metric_2")


def q_group_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sensors.group_average(
        readings(spark, sf_dir), "sensor_id",
        {"avg_metric_1": "metric_1", "avg_metric_2": "metric_2"},
    ))


def q_confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors.group_average(
        readings(spark, sf_dir), "sensor_id", {}, confidence=sensors.confidence_score()
    )


def q_label_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = _profiles(spark, sf_dir)
    return _rounded(sensors.label_by_bucket(profiles, zone_lookup(spark), "avg_metric_1"))


def q_default_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = sensors.label_by_bucket(
        _profiles(spark, sf_dir).select("sensor_id", "avg_metric_1"), zone_lookup(spark),
        "avg_metric_1",
    )
    return sensors.default_label(labelled, "zone_label").select("sensor_id", "zone_label")


def q_project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(enriched(spark, sf_dir))


def q_scalar_floor_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        floor_bucket(F.col("value") - 50.0).alias("bucket"),
        share_of(F.col("event_id"), 100.0).alias("share"),
        F.lit("reading").alias("kind"),
    )


def q_conform_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform_schema(table(spark, sf_dir, "orders"), ORDER_SLIP)


def q_build_sensor_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "profiles")
    jobs.build_sensor_profiles(spark, _readings_csv(spark, sf_dir), out)
    return _rounded(read_parquet(spark, out, schemas.SENSOR_PROFILE))


def q_enrich_with_zone_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "enriched")
    zones = _csv(spark, zone_lookup(spark), "zones")
    jobs.enrich_with_zone_label(spark, _profiles_path(spark, sf_dir), zones, out)
    return _rounded(read_parquet(spark, out, schemas.ENRICHED_PROFILE))


def q_sensor_zone_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(jobs.sensor_zone_pipeline(
        spark,
        _readings_csv(spark, sf_dir),
        _csv(spark, zone_lookup(spark), "zones"),
        scratch_path(spark, "profiles"),
        scratch_path(spark, "enriched"),
    ))


def q_outcome_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors.outcome_count(
        enriched(spark, sf_dir), "zone_label", sensors.UNMATCHED_LABEL
    )


def q_lookup_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("bucket"), F.col("p_type").alias("zone_label")
    )
    return sensors.lookup_check(sizes.distinct())


def q_job_run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = scratch_path(spark, "runs")
    jobs.sensor_zone_pipeline(
        spark,
        _readings_csv(spark, sf_dir),
        _csv(spark, zone_lookup(spark), "zones"),
        scratch_path(spark, "profiles"),
        scratch_path(spark, "enriched"),
        runs,
    )
    return read_parquet(spark, runs, schemas.JOB_RUN).select(
        "job", "status", "status_reason", "rows_written",
        (F.col("start_time") <= F.col("end_time")).alias("in_order"),
    )


QUERIES = {
    "read_csv_typed": q_read_csv_typed,
    "read_parquet": q_read_parquet,
    "write_parquet_overwrite": q_write_parquet_overwrite,
    "filter_present_key": q_filter_present_key,
    "group_average": q_group_average,
    "confidence_score": q_confidence_score,
    "label_by_bucket": q_label_by_bucket,
    "default_label": q_default_label,
    "project_columns": q_project_columns,
    "scalar_floor_cast": q_scalar_floor_cast,
    "conform_schema": q_conform_schema,
    "build_sensor_profiles": q_build_sensor_profiles,
    "enrich_with_zone_label": q_enrich_with_zone_label,
    "sensor_zone_pipeline": q_sensor_zone_pipeline,
    "outcome_count": q_outcome_count,
    "lookup_check": q_lookup_check,
    "job_run_record": q_job_run_record,
}

_SLIP_SQL = "SELECT o_totalprice, o_orderkey, o_orderpriority FROM orders"

_PROFILES_OUT = f"""WITH {PROFILES_SQL}
SELECT sensor_id, ROUND(avg_metric_1, 9) AS avg_metric_1,
       ROUND(avg_metric_2, 9) AS avg_metric_2, CAST(confidence AS DOUBLE) AS confidence
FROM profiles"""

_ENRICHED_OUT = f"""WITH {ENRICHED_SQL}
SELECT sensor_id, ROUND(avg_metric_1, 9) AS avg_metric_1,
       ROUND(avg_metric_2, 9) AS avg_metric_2, zone_label
FROM enriched"""

ORACLE = {
    "read_csv_typed": _SLIP_SQL,
    "read_parquet": _PROFILES_OUT,
    "write_parquet_overwrite": "SELECT * FROM customer",
    "filter_present_key": f"""WITH {READINGS_SQL}
SELECT sensor_id, ROUND(metric_1, 6) AS metric_1, metric_2
FROM readings WHERE sensor_id IS NOT NULL AND sensor_id <> ''""",
    "group_average": f"""WITH {READINGS_SQL}
SELECT sensor_id, ROUND(AVG(metric_1), 9) AS avg_metric_1,
       ROUND(AVG(metric_2), 9) AS avg_metric_2
FROM readings GROUP BY sensor_id""",
    "confidence_score": f"""WITH {READINGS_SQL}
SELECT sensor_id, CAST(COUNT(*) / 100.0 AS DOUBLE) AS confidence
FROM readings GROUP BY sensor_id""",
    "label_by_bucket": f"""WITH {ENRICHED_SQL}
SELECT sensor_id, ROUND(avg_metric_1, 9) AS avg_metric_1,
       ROUND(avg_metric_2, 9) AS avg_metric_2, CAST(confidence AS DOUBLE) AS confidence,
       zones.zone_label
FROM profiles LEFT JOIN zones ON CAST(FLOOR(avg_metric_1) AS INTEGER) = bucket""",
    "default_label": f"WITH {ENRICHED_SQL} SELECT sensor_id, zone_label FROM enriched",
    "project_columns": _ENRICHED_OUT,
    "scalar_floor_cast": """SELECT event_id, CAST(FLOOR(value - 50.0) AS INTEGER) AS bucket,
       event_id / CAST(100 AS DOUBLE) AS share, 'reading' AS kind
FROM events""",
    "conform_schema": _SLIP_SQL,
    "build_sensor_profiles": _PROFILES_OUT,
    "enrich_with_zone_label": _ENRICHED_OUT,
    "sensor_zone_pipeline": _ENRICHED_OUT,
    "outcome_count": f"""WITH {ENRICHED_SQL}
SELECT COUNT(*) FILTER (WHERE zone_label = 'unknown') AS outcome_rows, COUNT(*) AS total_rows
FROM enriched""",
    "lookup_check": """WITH listings AS (
  SELECT p_size, COUNT(DISTINCT p_type) AS n FROM part GROUP BY p_size)
SELECT 'listings_equal_to' AS test,
       CASE WHEN COUNT(*) FILTER (WHERE n <> 1) = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status,
       COUNT(*) FILTER (WHERE n <> 1) AS violations, COUNT(*) AS total_rows
FROM listings""",
    "job_run_record": f"""WITH {ENRICHED_SQL}
SELECT 'build_sensor_profiles' AS job, 'SUCCESS' AS status,
       'Wrote ' || CAST(COUNT(*) AS VARCHAR) || ' rows.' AS status_reason,
       COUNT(*) AS rows_written, TRUE AS in_order FROM profiles
UNION ALL
SELECT 'enrich_with_zone_label', 'SUCCESS',
       'Wrote ' || CAST(COUNT(*) AS VARCHAR) || ' rows, ' ||
       CAST(COUNT(*) FILTER (WHERE zone_label = 'unknown') AS VARCHAR) || ' unknown labels.',
       COUNT(*), TRUE FROM enriched""",
}
