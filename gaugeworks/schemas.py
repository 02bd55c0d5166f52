"""Table schemas, one StructType per table."""

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_STRING, _DOUBLE, _INT = T.StringType(), T.DoubleType(), T.IntegerType()

READING = _table(sensor_id=_STRING, metric_1=_DOUBLE, metric_2=_DOUBLE, ts=_STRING)

SENSOR_PROFILE = _table(
    sensor_id=_STRING, avg_metric_1=_DOUBLE, avg_metric_2=_DOUBLE, confidence=_DOUBLE
)

ZONE_LOOKUP = _table(bucket=_INT, zone_label=_STRING)

ENRICHED_PROFILE = _table(
    sensor_id=_STRING, avg_metric_1=_DOUBLE, avg_metric_2=_DOUBLE, zone_label=_STRING
)

JOB_RUN = _table(
    run_id=_STRING,
    job=_STRING,
    start_time=T.TimestampType(),
    end_time=T.TimestampType(),
    status=_STRING,
    status_reason=_STRING,
    rows_written=T.LongType(),
)
