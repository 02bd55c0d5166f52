import math
import random
import statistics

import pytest

from gaugeworks import schemas
from gaugeworks.operators.conform import SchemaMismatch, conform_schema
from gaugeworks.operators.sensors import (
    lookup_check, outcome_count, sensor_profiles, zoned_profiles,
)


def readings(spark, rows):
    return spark.createDataFrame(rows, schemas.READING)


def profiles(spark, rows):
    return spark.createDataFrame(rows, schemas.SENSOR_PROFILE)


def by_sensor(df):
    return {row["sensor_id"]: row for row in df.collect()}


def test_profiles_of_mixed_readings(spark):
    """Means skip nulls, every reading of a usable key counts, and a count may pass the whole."""
    rows = [("pump", 4.0 * i, 1.0 - i, "x") for i in range(5)]
    rows += [("valve", 6.5, None, "x"), ("valve", None, None, None)]
    rows += [("idle", None, 2.25, "x"), (" ", -3.0, 3.0, "x"), ("", 8.0, 8.0, "x"), (None, 9.0, 9.0, "x")]
    rows += [("busy", float(i % 3), None, "x") for i in range(150)]
    got = {k: tuple(r)[1:] for k, r in by_sensor(sensor_profiles(readings(spark, rows))).items()}
    assert got == {
        "pump": (8.0, -1.0, 0.05), "valve": (6.5, None, 0.02), "idle": (None, 2.25, 0.01), " ": (-3.0, 3.0, 0.01),
        "busy": (1.0, None, 1.5),
    }


def test_profiles_match_plain_python(spark):
    rng = random.Random(8)
    rows = [
        (rng.choice([None, "", "p", "q", "r", "s t"]), rng.choice([None, rng.uniform(-9, 9)]), rng.uniform(0, 1), None)
        for _ in range(500)
    ]
    got = by_sensor(sensor_profiles(readings(spark, rows)))
    assert set(got) == {"p", "q", "r", "s t"}
    for key, row in got.items():
        first = [r[1] for r in rows if r[0] == key and r[1] is not None]
        second = [r[2] for r in rows if r[0] == key]
        want = (statistics.fmean(first), statistics.fmean(second), len(second) / 100)
        assert tuple(row)[1:] == pytest.approx(want)


def test_every_profile_gets_one_zone_or_none(spark):
    zones = spark.createDataFrame([(b, f"z{b}") for b in range(3, 9, 2)], schemas.ZONE_LOOKUP)
    df = zoned_profiles(profiles(spark, [(f"s{i}", i / 2, None, 0.5) for i in range(20)]), zones)
    assert df.columns == schemas.ENRICHED_PROFILE.fieldNames()
    got = {k: v.zone_label for k, v in by_sensor(df).items()}
    assert got == {f"s{i}": f"z{i // 2}" if i // 2 in (3, 5, 7) else "unknown" for i in range(20)}
    assert lookup_check(zones).first().status == "SUCCESS"


def test_edges_of_the_bucket_rule(spark):
    lookup = spark.createDataFrame(
        [(-1, "below"), (0, "zero"), (7, None), (8, "first"), (8, "second")], schemas.ZONE_LOOKUP
    )
    df = zoned_profiles(profiles(spark, [
        ("negative", -0.5, 0.0, 0.1), ("nan", math.nan, 0.0, 0.1), ("huge", 1e12, 0.0, 0.1),
        ("none", None, 0.0, 0.1), ("null label", 7.5, 0.0, 0.1), ("double", 8.0, 0.0, 0.1),
    ]), lookup)
    got = sorted((r.sensor_id, r.zone_label) for r in df.collect())
    assert got == [
        ("double", "first"), ("double", "second"), ("huge", "unknown"), ("nan", "zero"),
        ("negative", "below"), ("none", "unknown"), ("null label", "unknown"),
    ]
    check = lookup_check(lookup).first()
    assert (check.test, check.status, check.violations) == ("listings_equal_to", "FAILED", 1)
    counts = outcome_count(df, "zone_label", "unknown").first()
    assert (counts.outcome_rows, counts.total_rows) == (3, 7)


def test_conform_orders_columns_and_names_every_problem(spark):
    df = spark.createDataFrame([("x", "y", 5)], "metric_1 string, sensor_id string, ts int")
    with pytest.raises(SchemaMismatch, match="metric_1 is string, expected double; column metric_2 is missing"):
        conform_schema(df, schemas.READING)
    wide = spark.createDataFrame([("z", 3, "more")], "zone_label string, Bucket int, extra string")
    assert conform_schema(wide, schemas.ZONE_LOOKUP).columns == ["bucket", "zone_label"]
    narrow = spark.createDataFrame([(3, "z")], "bucket bigint, zone_label string")
    with pytest.raises(SchemaMismatch, match="bucket is bigint, expected int"):
        conform_schema(narrow, schemas.ZONE_LOOKUP)


def test_conform_widens_types(spark):
    df = spark.createDataFrame([(7, 1, 2.5, None)], "sensor_id int, metric_1 int, metric_2 float, ts date")
    got = conform_schema(df, schemas.READING)
    assert got.schema == schemas.READING
    assert tuple(got.first()) == ("7", 1.0, 2.5, None)
