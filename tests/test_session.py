import os
import subprocess
import sys

import pytest

from gaugeworks.session import scratch_path, settle, shared_dir


def test_folder_named_by_the_session_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(named + "/gaugeworks/x-")


def test_settled_rows_come_from_the_folder(spark):
    df = settle(spark.range(5).selectExpr("id", "CAST(NULL AS STRING) AS t"))
    assert df.inputFiles() and all(spark.conf.get("spark.checkpoint.dir") in f for f in df.inputFiles())
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    assert settle(spark.range(0)).isEmpty()


class Cluster:
    """A session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(name, default):
            return default

    class sparkContext:
        master = "spark://host:7077"
        applicationId = "app"


def test_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_local_session_without_the_setting_gets_one_folder():
    class Local(Cluster):
        class sparkContext:
            master = "local[2]"
            applicationId = "local-1"

    assert shared_dir(Local) == shared_dir(Local)


def test_command_line_runs_a_job(tmp_path):
    (tmp_path / "r.csv").write_text("sensor_id,metric_1,metric_2,ts\na,20.5,1,t\na,21.5,3,t\n")
    out = tmp_path / "out"
    done = subprocess.run(
        [sys.executable, "-m", "gaugeworks", "build_sensor_profiles",
         "--input-path", str(tmp_path / "r.csv"), "--output-path", str(out)],
        capture_output=True, text=True, timeout=240,
        env={**os.environ, "PYSPARK_SUBMIT_ARGS":
             "--master local[2] --conf spark.ui.enabled=false pyspark-shell"},
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert list(out.glob("*.parquet"))
