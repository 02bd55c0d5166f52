"""Sensor readings to profiles, profiles to zones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.functions.scalars import floor_bucket, has_text, or_default, share_of
from gaugeworks.operators.conform import conform_schema
from gaugeworks.operators.joins import sized_join
from gaugeworks.operators.quality import dq_equal_to

# Readings that make a confidence of 1, and the label of unmatched sensors.
FULL_CONFIDENCE_READINGS = 100.0
UNMATCHED_LABEL = "unknown"


def filter_present_key(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is neither null nor empty."""
    return df.where(has_text(F.col(key)))


def confidence_score() -> Column:
    """Readings per group over 100, rows with null metrics included; may exceed 1."""
    return share_of(F.count(F.lit(1)), FULL_CONFIDENCE_READINGS)


def group_average(
    df: DataFrame, key: str, metrics: Mapping[str, str], **extra: Column
) -> DataFrame:
    """One row per key with the mean of each metric, nulls left out.

    `metrics` maps output names to input columns; `extra` holds further aggregates
    for the same shuffle. Partial aggregation keeps hot keys to one row per task.
    """
    means = [F.avg(column).alias(name) for name, column in metrics.items()]
    return df.groupBy(key).agg(*means, *[c.alias(name) for name, c in extra.items()])


def sensor_profiles(readings: DataFrame) -> DataFrame:
    """Profile of each sensor that has a usable key."""
    averaged = group_average(
        filter_present_key(readings, "sensor_id"),
        "sensor_id",
        {f"avg_{metric}": metric for metric in ("metric_1", "metric_2")},
        confidence=confidence_score(),
    )
    return conform_schema(averaged, schemas.SENSOR_PROFILE)


def label_by_bucket(df: DataFrame, lookup: DataFrame, metric: str) -> DataFrame:
    """Left join to a (bucket, zone_label) lookup on the floor of a metric.

    Rows without a match keep a null label. A bucket listed twice in the lookup
    yields one row per listing, as any left join does.
    """
    labels = lookup.select(F.col("bucket").alias("_bucket"), "zone_label")
    bucketed = df.withColumn("_bucket", floor_bucket(F.col(metric)))
    return sized_join(bucketed, labels, ["_bucket"], "left").drop("_bucket")


def default_label(df: DataFrame, column: str, default: str = UNMATCHED_LABEL) -> DataFrame:
    """Replace null labels, whether unmatched or null in the lookup itself."""
    return df.withColumn(column, or_default(F.col(column), default))


def zoned_profiles(profiles: DataFrame, lookup: DataFrame) -> DataFrame:
    """Profiles with their zone; the confidence column is not carried over."""
    needed = profiles.select("sensor_id", "avg_metric_1", "avg_metric_2")
    labelled = label_by_bucket(needed, lookup, "avg_metric_1")
    return conform_schema(default_label(labelled, "zone_label"), schemas.ENRICHED_PROFILE)


def lookup_check(lookup: DataFrame) -> DataFrame:
    """Rule result: each bucket is listed once. A violation is a bucket listed more often.

    Repeated buckets multiply rows in `label_by_bucket`, so check a lookup before use.
    """
    listings = lookup.groupBy("bucket").agg(F.count(F.lit(1)).alias("listings"))
    return dq_equal_to(listings, "listings", 1, "zone_lookup")


def outcome_count(df: DataFrame, column: str, outcome: str) -> DataFrame:
    """How many rows took an outcome, and out of how many."""
    return df.agg(
        F.count_if(F.col(column) == outcome).alias("outcome_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )
