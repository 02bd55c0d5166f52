import math
import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import medians, profiling
from gaugeworks.operators.medians import exact_medians
from gaugeworks.operators.profiling import (
    column_profile, column_sample_values, sample_payload, sample_rows, table_profile,
)
from gaugeworks.operators.quality import (
    BETWEEN, EQUAL_TO, NOT_NULL, DqRule, dq_between, dq_equal_to, dq_incidents, dq_not_null,
    dq_pass_rate_daily, dq_suite_run, latest_status, lineage_dq_badge, union_results,
)

RESULT = "entity string, test string, run_id long, ts timestamp, status string, message string"


def test_rules_over_one_table(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 1), ("b", 1.0, 1), ("c", 2.2, 2), (None, None, None)],
        "sensor_id string, confidence double, n int")
    got = {r.test: r for r in dq_suite_run(df, [
        DqRule("key", "sensor_id", NOT_NULL, suite="s"),
        DqRule("range", "confidence", BETWEEN, 0, 1, suite="s"),
        DqRule("one", "n", EQUAL_TO, value=1, suite="s"),
        DqRule("wide", "confidence", BETWEEN, 0, 5, suite="s"),
    ], "profiles", datetime(2024, 1, 1)).collect()}
    assert (got["key"].status, got["key"].violations, got["key"].total) == ("FAILED", 1, 4)
    assert (got["range"].status, got["range"].violations) == ("FAILED", 1)
    assert (got["range"].observed_min, got["range"].observed_max) == (0.0, 2.2)
    assert got["range"].message == "1 values of confidence not within 0 to 1, observed 0.00 to 2.20"
    assert (got["one"].status, got["one"].violations) == ("FAILED", 1)
    assert got["wide"].status == "SUCCESS"  # bounds count as inside, nulls are no violation
    assert got["key"].suite == "s" and got["key"].ts == datetime(2024, 1, 1)


def test_suite_is_one_pass(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS x", "id AS unused").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = dq_suite_run(df, [DqRule("a", "id", NOT_NULL), DqRule("b", "x", BETWEEN, 0, 9)], "t")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "unused" not in text


def test_single_rules(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 3.0)], "k string, x double")
    assert tuple(dq_not_null(df, "k", "t").first()) == ("k_not_null", "FAILED", 1, 2)
    assert tuple(dq_between(df, "x", 1, 3, "t").first()) == ("x_in_range", "SUCCESS", 0, 1.0, 3.0)
    assert tuple(dq_equal_to(df, "x", 3.0, "t").first()) == ("x_equal_to", "FAILED", 1, 2)
    assert dq_not_null(df.limit(0), "k", "t").first().status == "SUCCESS"


def test_badges_incidents_rates_and_union(spark):
    day = [datetime(2024, 1, d) for d in (1, 2)]
    native = spark.createDataFrame([
        ("e1", "t1", 1, day[0], "FAILED", "m1"), ("e1", "t1", 2, day[1], "SUCCESS", "m2"),
        ("e2", "t2", 3, day[1], "SUCCESS", "m3"), ("e2", "t2", 4, day[1], "FAILED", "m4"),
    ], RESULT)
    nodes = spark.createDataFrame([("e1",), ("e2",), ("e2",), ("e3",)], "entity string")
    assert {tuple(r) for r in lineage_dq_badge(nodes, native).collect()} == {
        ("e1", "green", 0, 1), ("e2", "red", 1, 1), ("e3", "none", 0, 0)}
    assert {r.test: r.status for r in latest_status(native).collect()} == {
        "t1": "SUCCESS", "t2": "FAILED"}
    assert sorted(r.incident for r in dq_incidents(native).collect()) == ["t1/1", "t2/4"]
    assert {r.day: (r.runs, round(r.pass_rate, 6)) for r in dq_pass_rate_daily(native).collect()} == {
        day[0]: (1, 0.0), day[1]: (3, round(2 / 3, 6))}
    external = spark.createDataFrame([("e9", "x", "SUCCESS", 7)], "entity string, test string, status string, score int")
    both = union_results(native, ("SUITE_X", external))
    assert both.where("source = 'SUITE_X' AND run_id IS NULL AND score = 7").count() == 1
    assert both.where("source = 'NATIVE' AND score IS NULL").count() == 4


def exact(values):
    values = [v for v in values if v is not None]
    return statistics.median(values) if values else None


@pytest.mark.parametrize("small", [3, 100, 100_000])
def test_medians_match_brute_force(spark, small):
    rnd = random.Random(small)
    n = 4001
    columns = {
        "normal": [rnd.gauss(0, 1) for _ in range(n)],
        "flags": [float(i % 2) for i in range(n)],
        "even_flags": [None] + [float(i % 2) for i in range(n - 1)],
        "hot": [7.0 if rnd.random() < 0.4 else rnd.random() * 14 for _ in range(n)],
        "outlier": [1e300] + [float(i) for i in range(n - 1)],
        "same": [4.0] * n,
        "one": [3.5] + [None] * (n - 1),
        "empty": [None] * n,
    }
    df = spark.createDataFrame(
        list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(6)
    got = exact_medians(df, list(columns), small)
    assert got == {c: exact(v) for c, v in columns.items()}


@pytest.mark.parametrize("spread", ["decades", "cluster", "hot"])
def test_median_scans_are_few_however_values_are_spread(spark, monkeypatch, spread):
    values = {
        "decades": [10.0 ** (i / 20 - 100) for i in range(4001)],
        "cluster": [1e300, -1e300] + [1 + i * 2.0**-52 for i in range(3999)],
        "hot": [0.5] * 3000 + [float(i) for i in range(1001)],
    }[spread]
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(4)
    rounds = []
    cut = medians._cut_ranges
    monkeypatch.setattr(medians, "_cut_ranges", lambda *a: (rounds.append(1), cut(*a)))
    assert exact_medians(df, ["a"], small=10) == {"a": statistics.median(values)}
    assert len(rounds) <= 2


def test_medians_of_infinities_and_nan(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame(
        [(-inf, 1.0, nan), (-inf, inf, nan), (2.0, inf, 1.0)], "a double, b double, c double")
    got = exact_medians(df, ["a", "b", "c"])
    assert (got["a"], got["b"]) == (-inf, inf) and math.isnan(got["c"])
    wide = spark.createDataFrame([(-1.7e308,), (1.7e308,), (3.0,)], "a double")
    assert exact_medians(wide, ["a"], small=1) == {"a": 3.0}
    tiny = spark.createDataFrame([(0.0,), (5e-324,), (5e-324,), (1e-323,)], "a double")
    assert exact_medians(tiny, ["a"], small=1) == {"a": 5e-324}


def test_column_profile_against_brute_force(spark):
    rows = [("a", 1, 2.5, True), ("b", 2, None, False), ("", 2, math.inf, None), (None, 9, -1.0, True)]
    df = spark.createDataFrame(rows, "s string, i int, d double, b boolean")
    got = {r.column: r for r in column_profile(df, "t").collect()}
    s, i, d, b = (got[c] for c in "sidb")
    assert (s.values_count, s.null_count, s.missing_count, s.unique_count) == (4, 1, 2, 3)
    assert (s.null_proportion, s.unique_proportion, s.min, s.max) == (0.25, 0.75, "", "b")
    assert (s.mean, s.median) == (None, None)
    assert (i.unique_count, i.min, i.max, i.mean, i.median) == (3, "1", "9", 3.5, 2.0)
    assert (d.unique_count, d.min, d.max, d.median) == (3, "-1.0", "Infinity", 2.5)
    assert (b.unique_count, b.min, b.null_count) == (2, None, 1)
    rough = {r.column: r for r in column_profile(df, "t", approximate=True).collect()}
    assert rough["i"].unique_count == 3 and rough["i"].median == 2.0
    none = {r.column: r for r in column_profile(df.limit(0), "t").collect()}
    assert none["s"].unique_count == 0 and none["s"].null_proportion is None


def test_table_profile_counts_files(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(1000).repartition(3).write.parquet(str(path))
    spark.range(0).coalesce(1).write.mode("append").parquet(str(path))
    stored = sum(f.stat().st_size for f in path.glob("*.parquet"))
    assert len(list(path.glob("*.parquet"))) == 4  # one of them without rows
    row = table_profile(spark.read.parquet(str(path)), str(path), "t").first()
    assert (row.row_count, row.column_count, row.size_in_bytes) == (1000, 1, stored)


@pytest.mark.parametrize("n", [1, 3, 20])
def test_sample_values_match_brute_force(spark, n):
    rnd = random.Random(n)
    rows = [(f"k{rnd.randrange(500):03}", rnd.choice(["x", "y", None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(5)
    got = [(r.column, r["rank"], r.value) for r in column_sample_values(df, n).collect()]
    want = [("a", i + 1, v) for i, v in enumerate(sorted({r[0] for r in rows})[:n])]
    assert sorted(got) == want + [("b", 1, "x"), ("b", 2, "y")][:n]


def test_sample_values_follow_the_type(spark):
    df = spark.createDataFrame(
        [(10, -0.5, datetime(2024, 1, 2), True, [2]), (9, math.nan, datetime(2023, 1, 2), None, [1]),
         (10, 1e-7, None, True, [1])],
        "i int, d double, t timestamp_ntz, b boolean, a array<int>")
    got = {}
    for r in column_sample_values(df, 4).orderBy("rank").collect():
        got.setdefault(r.column, []).append(r.value)
    assert got == {
        "i": ["9", "10"], "d": ["-0.5", "1.0E-7", "NaN"], "b": ["true"], "a": ["[1]", "[2]"],
        "t": ["2023-01-02 00:00:00", "2024-01-02 00:00:00"],
    }


def test_sample_rows_and_payload(spark):
    df = spark.range(50).select((F.lit(49) - F.col("id")).alias("n"), F.lit("x").alias("t"))
    assert [r.n for r in sample_rows(df, 3).collect()] == [0, 1, 2]
    payload = sample_payload(df, 2, ["n"]).first()
    assert payload.columns == ["n", "t"] and payload.rows == [["0", "x"], ["1", "x"]]


@pytest.mark.parametrize("n", [1, 3, 50])
def test_sample_values_of_frequent_and_many_values(spark, monkeypatch, n):
    """Few values, many, a smallest value in every bucket, and signed zeros, all at once."""
    monkeypatch.setattr(profiling, "FEW_VALUES", 60)
    rnd = random.Random(n)
    rows = [(i % 7, rnd.randrange(10**6), 0 if i % 50 else i, (-0.0, 0.0, float(i))[i % 3]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "few int, many long, hot long, z double").repartition(3)
    got = {}
    for r in column_sample_values(df, n).orderBy("column", "rank").collect():
        got.setdefault(r.column, []).append(float(r.value))
    columns = dict(zip(df.columns, zip(*rows)))
    assert got == {name: [float(v) for v in sorted(set(values))[:n]] for name, values in columns.items()}
