"""Run records: one row per executed job."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.sources.files import write_parquet_overwrite


def write_recorded(
    df: DataFrame,
    path: str,
    job: str,
    runs_path: str,
    counts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Write a table and append a run record; returns the record as one row.

    Rows are counted by the write itself, and so are further outcomes: `counts` maps their
    names to aggregates, and both appear in the reason. The observation sits in the last
    stage, where Spark counts each partition once however often its task was tried. A
    failed write is recorded too, then raised again.
    """
    counts = dict(counts or {})
    spark = df.sparkSession
    seen = Observation()
    started = datetime.now(timezone.utc)
    status, reason, rows, failure = "SUCCESS", None, None, None
    try:
        outcomes = [c.alias(f"outcome_{i}") for i, c in enumerate(counts.values())]
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *outcomes)
        write_parquet_overwrite(observed, path)
        rows = seen.get["rows"]
        reason = ", ".join(
            [f"Wrote {rows} rows"]
            + [f"{seen.get[f'outcome_{i}']} {name}" for i, name in enumerate(counts)]
        ) + "."
    except Exception as error:  # recorded, then raised below
        status, reason, failure = "FAILED", f"{type(error).__name__}: {error}", error
    record = spark.createDataFrame(
        [(uuid.uuid4().hex, job, started, datetime.now(timezone.utc), status, reason, rows)],
        schemas.JOB_RUN,
    )
    record.coalesce(1).write.mode("append").parquet(runs_path)
    if failure is not None:
        raise failure
    return record
