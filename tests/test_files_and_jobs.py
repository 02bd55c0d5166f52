import pytest
from pyspark.sql import functions as F

from gaugeworks import __main__ as cli
from gaugeworks import schemas
from gaugeworks.operators.conform import SchemaMismatch
from gaugeworks.operators.runs import write_recorded
from gaugeworks.plans import jobs
from gaugeworks.sources.files import read_csv_typed, read_parquet, write_parquet_overwrite

READINGS = """ts,extra,sensor_id,metric_1,metric_2
2024-01-01T00:00:00,x,sensor_a,20.5,1
2024-01-01T00:00:00,x,sensor_a,20.7,bad
2024-01-01T00:00:00,x,,24.0,1
2024-01-01T00:00:00,x,"",24.0,1
2024-01-01T00:00:00,x,sensor_b,93.5,2
"""
ZONES = "bucket,zone_label\n20,zone_a\n21,zone_b\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "readings.csv").write_text(READINGS)
    (tmp_path / "zones.csv").write_text(ZONES)
    return tmp_path


def test_csv_columns_by_name_bad_numbers_null(spark, files):
    df = read_csv_typed(spark, str(files / "readings.csv"), schemas.READING)
    assert df.schema.fieldNames() == schemas.READING.fieldNames()
    assert [f.dataType for f in df.schema] == [f.dataType for f in schemas.READING]
    rows = df.collect()
    assert [r.metric_2 for r in rows] == [1.0, None, 1.0, 1.0, 2.0]
    assert [r.sensor_id for r in rows] == ["sensor_a", "sensor_a", None, None, "sensor_b"]


def test_csv_without_a_needed_column_is_an_error(spark, files):
    with pytest.raises(SchemaMismatch, match="bucket, zone_label"):
        read_csv_typed(spark, str(files / "readings.csv"), schemas.ZONE_LOOKUP)


def test_parquet_overwrite_replaces_and_read_checks_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    write_parquet_overwrite(spark.range(5), path)
    write_parquet_overwrite(spark.range(2), path)
    assert read_parquet(spark, path).count() == 2
    with pytest.raises(SchemaMismatch):
        read_parquet(spark, path, schemas.SENSOR_PROFILE)


def test_pipeline_through_files(spark, files):
    out = jobs.sensor_zone_pipeline(
        spark, str(files / "readings.csv"), str(files / "zones.csv"),
        str(files / "profiles"), str(files / "enriched"),
    )
    got = {r.sensor_id: (round(r.avg_metric_1, 6), r.avg_metric_2, r.zone_label)
           for r in out.collect()}
    assert got == {"sensor_a": (20.6, 1.0, "zone_a"), "sensor_b": (93.5, 2.0, "unknown")}
    profiles = read_parquet(spark, str(files / "profiles"), schemas.SENSOR_PROFILE)
    assert {r.sensor_id: r.confidence for r in profiles.collect()} == {
        "sensor_a": 0.02, "sensor_b": 0.01}


def test_command_line_needs_every_option(capsys):
    with pytest.raises(SystemExit):
        cli.parse(["build_sensor_profiles", "--input-path", "x"])
    assert "--output-path" in capsys.readouterr().err
    options = cli.parse([
        "enrich_with_zone_label", "--sensor-profiles-path", "a", "--zone-lookup-path", "b",
        "--output-path", "c",
    ])
    assert (options.sensor_profiles_path, options.zone_lookup_path, options.output_path) == (
        "a", "b", "c")


def test_run_records_success_and_failure(spark, tmp_path):
    runs = str(tmp_path / "runs")
    write_recorded(
        spark.range(1000).repartition(4), str(tmp_path / "good"), "good", runs,
        {"even ids": F.count_if(F.col("id") % 2 == 0), "ids over 2000": F.count_if(F.col("id") > 2000)},
    )
    broken = spark.range(10).selectExpr("raise_error('no such reading') AS x")
    with pytest.raises(Exception, match="no such reading"):
        write_recorded(broken, str(tmp_path / "bad"), "bad", runs)
    got = {r.job: r for r in spark.read.parquet(runs).collect()}
    assert (got["good"].status, got["good"].rows_written, got["good"].status_reason) == (
        "SUCCESS", 1000, "Wrote 1000 rows, 500 even ids, 0 ids over 2000.")
    assert got["good"].start_time <= got["good"].end_time
    assert got["bad"].status == "FAILED" and got["bad"].rows_written is None
