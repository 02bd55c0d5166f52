"""Identity strings of catalogued entities, and the JSON envelope of aspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The identity formats and the envelope's constant fields.
DATASET_URN = "urn:li:dataset:(urn:li:dataPlatform:%s,%s.%s,%s)"
FLOW_URN = "urn:li:dataFlow:(%s,%s.%s,%s)"
JOB_URN = "urn:li:dataJob:(%s,%s)"
PATH_NAME = "//%s/host/%s/path%s"
CHANGE_TYPE = "UPSERT"
CONTENT_TYPE = "application/json"

_CONTENT = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("contentType", T.StringType()),
])
ENVELOPE = T.StructType([
    T.StructField("entityType", T.StringType()),
    T.StructField("entityUrn", T.StringType()),
    T.StructField("aspectName", T.StringType()),
    T.StructField("changeType", T.StringType()),
    T.StructField("aspect", _CONTENT),
])


def dotted_name(*parts: Column) -> Column:
    """service.database.schema.table; null as soon as one part is."""
    pieces = [parts[0]]
    for part in parts[1:]:
        pieces += [F.lit("."), part]
    return F.concat(*pieces)


def dataset_urn(instance: str, path: Column, platform: str = "file", env: str = "PROD") -> Column:
    return F.format_string(DATASET_URN, F.lit(platform), F.lit(instance), path, F.lit(env))


def job_urn(
    instance: str, flow: Column, job: Column, engine: str = "spark", env: str = "PROD"
) -> Column:
    """Job identity, nesting the identity of the flow it belongs to."""
    parent = F.format_string(FLOW_URN, F.lit(engine), F.lit(instance), flow, F.lit(env))
    return F.format_string(JOB_URN, parent, job)


def path_name(path: Column, scheme: str = "file", host: str = "local") -> Column:
    return F.format_string(PATH_NAME, F.lit(scheme), F.lit(host), path)


def aspect_encode(entity_type: Column, urn: Column, aspect_name: Column, aspect: Column) -> Column:
    """Write record of one aspect; the aspect itself is JSON text inside the JSON record."""
    content = F.struct(F.to_json(aspect).alias("value"), F.lit(CONTENT_TYPE).alias("contentType"))
    return F.to_json(
        F.struct(
            entity_type.alias("entityType"),
            urn.alias("entityUrn"),
            aspect_name.alias("aspectName"),
            F.lit(CHANGE_TYPE).alias("changeType"),
            content.alias("aspect"),
        )
    )


def aspect_decode(records: DataFrame, column: str, aspect_schema: T.StructType) -> DataFrame:
    """Replace a column of write records by their fields, the aspect parsed into a struct."""
    others = [c for c in records.columns if c != column]
    opened = records.withColumn(column, F.from_json(column, ENVELOPE))
    return opened.select(
        *others,
        F.col(f"{column}.entityType").alias("entity_type"),
        F.col(f"{column}.entityUrn").alias("urn"),
        F.col(f"{column}.aspectName").alias("aspect_name"),
        F.col(f"{column}.changeType").alias("change_type"),
        F.from_json(f"{column}.aspect.value", aspect_schema).alias("aspect"),
    )
