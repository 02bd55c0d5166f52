"""Typed file input and output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gaugeworks.functions.scalars import quoted
from gaugeworks.operators.conform import SchemaMismatch, conform_schema, match_names


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV, columns picked by name and converted to the schema's types.

    Columns the schema does not name are dropped; a column the file lacks is an
    error. Text that is no valid value of its type becomes null.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    found = match_names(spark, raw.columns, schema.fieldNames())
    absent = [name for name in schema.fieldNames() if name not in found]
    if absent:
        raise SchemaMismatch(f"{path}: no column {', '.join(absent)}")
    return raw.select([
        quoted(found[field.name]).try_cast(field.dataType).alias(field.name)
        for field in schema.fields
    ])


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Parquet table; with a schema, checked and reduced to its columns."""
    df = spark.read.parquet(path)
    return df if schema is None else conform_schema(df, schema)


def write_parquet_overwrite(df: DataFrame, path: str) -> None:
    """Write a Parquet table, replacing what is at the path."""
    df.write.mode("overwrite").parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes the file system keeps in a file, or below a folder."""
    stored = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = stored.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(stored).getLength()
