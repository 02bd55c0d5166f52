"""Results that must not depend on the session's zone, and outcomes in full."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import lineage, quality
from gaugeworks.operators.latest import aspect_versions, entity_page
from gaugeworks.operators.profiling import column_profile, column_sample_values


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("day", ["2025-03-09T01:00:00", "2025-11-02T00:30:00"])
def test_versions_over_clock_changes(new_york, day):
    first = datetime.fromisoformat(day)
    rows = [("u", "a", str(i), (first + timedelta(minutes=i)).isoformat(), i) for i in range(180)]
    log = new_york.createDataFrame(rows, "urn string, aspect string, value string, at string, seq long")
    log = log.withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at")
    got = {r.value: r.version for r in aspect_versions(log, slice_rows=20).collect()}
    assert got == {str(i): 179 - i for i in range(180)}


def test_repeated_hour_counts_twice(new_york):
    table = new_york.createDataFrame([(1762061400,), (1762065000,), (1762065000,)], "s long").select(
        F.timestamp_seconds("s").alias("at")
    )
    assert column_profile(table, "t").first()["unique_count"] == 2
    samples = column_sample_values(table, 3).collect()
    assert [(r["rank"], r["value"]) for r in samples] == [(1, "2025-11-02 01:30:00"), (2, "2025-11-02 01:30:00")]


def test_messages_in_full(spark):
    table = spark.createDataFrame([(1.0, None), (2.0, None)], "`a%d` double, empty double")
    rules = [
        quality.DqRule("x", "a%d", quality.NOT_NULL), quality.DqRule("y", "a%d", quality.BETWEEN, max_value=1234567),
        quality.DqRule("z", "empty", quality.BETWEEN, 0.5), quality.DqRule("w", "a%d", quality.EQUAL_TO, value=1.0),
        quality.DqRule("v", "a%d", quality.BETWEEN, min_value=1.5),
    ]
    got = {r["test"]: (r["message"], r["status"]) for r in quality.dq_suite_run(table, rules, "t").collect()}
    assert got == {
        "x": ("0 null in a%d, rows checked: 2", "SUCCESS"),
        "y": ("0 values of a%d not within any to 1234567, observed 1.00 to 2.00", "SUCCESS"),
        "z": ("0 values of empty not within 0.5 to any, observed none to none", "SUCCESS"),
        "w": ("1 values of a%d differ from 1.0, rows checked: 2", "FAILED"),
        "v": ("1 values of a%d not within 1.5 to any, observed 1.00 to 2.00", "FAILED"),
    }


def test_badge_of_a_test_in_error(spark):
    runs = [("p", "SUCCESS"), ("q", "ERROR"), ("r", "FAILED"), ("r", "ERROR")]
    results = spark.createDataFrame(
        [(e, f"t{i}", "c", s, 1, f"r{i}") for i, (e, s) in enumerate(runs)],
        "entity string, test string, column string, status string, ts int, run_id string",
    )
    nodes = spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "entity string")
    badges = {r["entity"]: r["badge"] for r in quality.lineage_dq_badge(nodes, results).collect()}
    assert badges == {"p": "green", "q": "error", "r": "red", "s": "none"}


def test_walk_has_no_depth_limit(spark, tmp_path):
    spark.createDataFrame([(str(i), str(i + 1)) for i in range(70)], "upstream string, downstream string").coalesce(
        1
    ).write.parquet(str(tmp_path / "edges"))
    walked = lineage.lineage_walk(spark.read.parquet(str(tmp_path / "edges")), "0", "downstream")
    assert walked.agg(F.max("hops")).first()[0] == 70


def test_page_of_whatever_aspects(spark):
    log = spark.createDataFrame(
        [("u", "x", "1", 1, 1), ("u", "x", "2", 2, 2), ("u", "own", "3", 1, 3), ("v", None, "4", 1, 4)],
        "urn string, aspect string, value string, ts int, seq int",
    )
    assert {r["urn"]: r["aspects"] for r in entity_page(log).collect()} == {"u": {"own": "3", "x": "2"}, "v": {}}
