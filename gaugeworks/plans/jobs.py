"""The two batch jobs and their chain through the Parquet table between them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.operators.runs import write_recorded
from gaugeworks.operators.sensors import UNMATCHED_LABEL, sensor_profiles, zoned_profiles
from gaugeworks.sources.files import read_csv_typed, read_parquet, write_parquet_overwrite


def build_sensor_profiles(
    spark: SparkSession, input_path: str, output_path: str, runs_path: str | None = None
) -> None:
    """Readings CSV to a Parquet table of sensor profiles; a run record goes to `runs_path`."""
    readings = read_csv_typed(spark, input_path, schemas.READING)
    _write(sensor_profiles(readings), output_path, "build_sensor_profiles", runs_path)


def enrich_with_zone_label(
    spark: SparkSession,
    sensor_profiles_path: str,
    zone_lookup_path: str,
    output_path: str,
    runs_path: str | None = None,
) -> None:
    """Sensor profiles (Parquet) and zone lookup (CSV) to labelled profiles.

    A run record goes to `runs_path`; it counts the sensors without a zone too.
    """
    profiles = read_parquet(spark, sensor_profiles_path, schemas.SENSOR_PROFILE)
    lookup = read_csv_typed(spark, zone_lookup_path, schemas.ZONE_LOOKUP)
    unknown = F.count_if(F.col("zone_label") == UNMATCHED_LABEL)
    _write(
        zoned_profiles(profiles, lookup), output_path, "enrich_with_zone_label", runs_path,
        {"unknown labels": unknown},
    )


def _write(
    df: DataFrame,
    path: str,
    job: str,
    runs_path: str | None,
    counts: Mapping[str, Column] | None = None,
) -> None:
    if runs_path is None:
        write_parquet_overwrite(df, path)
    else:
        write_recorded(df, path, job, runs_path, counts)


def sensor_zone_pipeline(
    spark: SparkSession,
    readings_path: str,
    zone_lookup_path: str,
    profiles_path: str,
    enriched_path: str,
    runs_path: str | None = None,
) -> DataFrame:
    """Both jobs in turn; returns the labelled table as read back from disk."""
    build_sensor_profiles(spark, readings_path, profiles_path, runs_path)
    enrich_with_zone_label(spark, profiles_path, zone_lookup_path, enriched_path, runs_path)
    return read_parquet(spark, enriched_path, schemas.ENRICHED_PROFILE)
