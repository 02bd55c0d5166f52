"""Column profiles that merge: one stored row of counts, ranges and sketches per batch of rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.scalars import is_blank, quoted, stamp
from gaugeworks.operators.profiling import comparable, is_ordered

HLL_LOG2 = 14  # distinct counts are off by about 1.04 / sqrt(2**14), under one percent
KLL_K = 1_000  # medians are off by a rank of about 0.3 percent of the rows


def profile_batch(df: DataFrame, path: str, batch: str) -> None:
    """Profile a batch of a table's rows and store it; the same batch again replaces itself.

    One scan, one row: counts, nulls, missing values, ranges and sums in the columns' own
    types, and per column a sketch of its distinct values and, of numbers, of their ranks.
    Sketches are some kilobytes per column, whatever the batch.
    """
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema.fields):
        column = quoted(field.name)
        _, value = comparable(column, field.dataType)
        aggregates += [
            F.count_if(column.isNull()).alias(f"nulls_{i}"),
            F.count_if(is_blank(column, field.dataType.typeName())).alias(f"missing_{i}"),
            F.hll_sketch_agg(F.when(column.isNotNull(), F.xxhash64(value)), HLL_LOG2).alias(f"hll_{i}"),
        ]
        if is_ordered(field.dataType):
            aggregates += [F.min(column).alias(f"min_{i}"), F.max(column).alias(f"max_{i}")]
        if isinstance(field.dataType, T.NumericType):
            # Sums of whole numbers as doubles, like avg, so that none overflows.
            exact = isinstance(field.dataType, T.DecimalType)
            aggregates += [
                F.sum(column if exact else column.cast("double")).alias(f"sum_{i}"),
                F.kll_sketch_agg_double(column.cast("double"), KLL_K).alias(f"kll_{i}"),
            ]
    df.agg(*aggregates).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def merged_profile(
    spark: SparkSession, path: str, schema: T.StructType, table: str, ts: datetime | Column | None = None
) -> DataFrame:
    """Profile of a whole table from the stored batches, in the columns of `column_profile`.

    Reads one row per batch and none of the table's. Counts, ranges and means are exact;
    distinct counts and medians are estimates (see HLL_LOG2, KLL_K), the latter an actual
    value. `schema` is that of the profiled rows.
    """
    stored = spark.read.parquet(path)
    merged = [F.sum("rows").alias("rows")]
    for i, field in enumerate(schema.fields):
        merged += [
            F.sum(f"nulls_{i}").alias(f"nulls_{i}"), F.sum(f"missing_{i}").alias(f"missing_{i}"),
            F.hll_sketch_estimate(F.hll_union_agg(f"hll_{i}")).alias(f"unique_{i}"),
        ]
        if is_ordered(field.dataType):
            merged += [F.min(f"min_{i}").alias(f"min_{i}"), F.max(f"max_{i}").alias(f"max_{i}")]
        if isinstance(field.dataType, T.NumericType):
            merged += [
                F.sum(f"sum_{i}").cast("double").alias(f"sum_{i}"),
                F.kll_merge_agg_double(f"kll_{i}", KLL_K).alias(f"kll_{i}"),
            ]
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    entries = []
    for i, field in enumerate(schema.fields):
        number, ordered = isinstance(field.dataType, T.NumericType), is_ordered(field.dataType)
        held = F.col("rows") - F.col(f"nulls_{i}")
        median = F.when(
            F.kll_sketch_get_n_double(f"kll_{i}") > 0, F.kll_sketch_get_quantile_double(f"kll_{i}", F.lit(0.5))
        ) if number else no_number
        entries.append(F.struct(
            F.lit(field.name).alias("column"),
            F.col("rows").alias("values_count"),
            F.col(f"nulls_{i}").alias("null_count"),
            F.col(f"missing_{i}").alias("missing_count"),
            F.least(F.col(f"unique_{i}"), held).alias("unique_count"),
            (F.col(f"min_{i}").cast("string") if ordered else no_text).alias("min"),
            (F.col(f"max_{i}").cast("string") if ordered else no_text).alias("max"),
            (F.try_divide(f"sum_{i}", held) if number else no_number).alias("mean"),
            median.alias("median"),
        ))
    profile = stored.agg(*merged).select(F.inline(F.array(*entries)))
    return profile.select(
        F.lit(table).alias("table"), "column", stamp(ts).alias("ts"),
        "values_count", "null_count", "missing_count", "unique_count",
        F.try_divide("null_count", "values_count").alias("null_proportion"),
        F.try_divide("unique_count", "values_count").alias("unique_proportion"),
        "min", "max", "mean", "median",
    )
