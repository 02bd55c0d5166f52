"""Check that a DataFrame has the columns a schema names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gaugeworks.functions.scalars import quoted

# Numeric types, each holding every value of those before it (to a double's precision).
_WIDENING = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


class SchemaMismatch(ValueError):
    """A required column is missing or has a type that does not fit."""


def match_names(spark: SparkSession, names: list[str], wanted: list[str]) -> dict[str, str]:
    """Wanted name to present name, compared as the session compares column names."""
    if spark.conf.get("spark.sql.caseSensitive", "false") == "true":
        return {want: want for want in wanted if want in names}
    present = {name.lower(): name for name in names}
    return {want: present[want.lower()] for want in wanted if want.lower() in present}


def conform_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in the schema's order and types; other columns are dropped.

    Types may be widened (int to double, number or date to text), never narrowed. Runs on
    the plan only, so a mismatch is reported before any task starts.
    """
    found = match_names(df.sparkSession, df.columns, schema.fieldNames())
    problems, columns = [], []
    for field in schema.fields:
        if field.name not in found:
            problems.append(f"column {field.name} is missing")
            continue
        have = df.schema[found[field.name]].dataType
        column = quoted(found[field.name])
        if have != field.dataType:
            column = column.cast(field.dataType)
            if not _widens(have, field.dataType):
                problems.append(
                    f"column {field.name} is {have.simpleString()}, "
                    f"expected {field.dataType.simpleString()}"
                )
        columns.append(column.alias(field.name))
    if problems:
        raise SchemaMismatch("; ".join(problems))
    return df.select(columns)


def _widens(have: T.DataType, want: T.DataType) -> bool:
    if isinstance(have, T.NullType):
        return True
    if isinstance(want, T.StringType):
        return isinstance(have, (T.NumericType, T.BooleanType, T.DatetimeType, T.TimestampNTZType))
    if type(have) in _WIDENING and type(want) in _WIDENING:
        return _WIDENING.index(type(have)) <= _WIDENING.index(type(want))
    return isinstance(have, T.DateType) and isinstance(want, (T.TimestampType, T.TimestampNTZType))
