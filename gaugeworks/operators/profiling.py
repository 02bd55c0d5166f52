"""Table profiles, column profiles and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.scalars import is_blank, quoted, stamp
from gaugeworks.operators.medians import exact_medians
from gaugeworks.sources.files import stored_bytes

#: Columns estimated to have at most so many distinct values may be collected whole.
FEW_VALUES = 10_000


def table_profile(
    df: DataFrame, path: str, table: str, ts: datetime | Column | None = None
) -> DataFrame:
    """Row count, column count and stored bytes of the table read from a path.

    Reads no column: rows are a plain count, which Parquet answers from its footers, and the
    size is what the file system keeps below the path, files without rows included.
    """
    return df.agg(
        F.lit(table).alias("table"),
        stamp(ts).alias("ts"),
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(stored_bytes(df.sparkSession, path)).cast("bigint").alias("size_in_bytes"),
    )


def column_profile(
    df: DataFrame,
    table: str,
    columns: Sequence[str] | None = None,
    *,
    approximate: bool = False,
    ts: datetime | Column | None = None,
) -> DataFrame:
    """One row per column: counts, proportions, range as text, mean and median.

    One global aggregate takes everything that needs no shuffle. Exact distinct counts
    add a pass that shuffles each column's distinct values, exact medians a few scans of
    the numeric columns (see `exact_medians`). With `approximate` both come from sketches
    inside the one aggregate; prefer it for wide tables.

    values_count counts rows, nulls included. Missing means null or the empty string. The
    table is read several times, so pass a stored one.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        column = quoted(field.name)
        aggregates += [
            F.count_if(column.isNull()).alias(f"nulls_{i}"),
            F.count_if(is_blank(column, field.dataType.typeName())).alias(f"missing_{i}"),
        ]
        if is_ordered(field.dataType):
            aggregates += [
                F.min(column).cast("string").alias(f"min_{i}"),
                F.max(column).cast("string").alias(f"max_{i}"),
            ]
        if field.name in numeric:
            aggregates.append(F.avg(column).cast("double").alias(f"mean_{i}"))
        if approximate:
            aggregates.append(F.approx_count_distinct(column).alias(f"unique_{i}"))
            if field.name in numeric:
                aggregates.append(
                    F.percentile_approx(column.cast("double"), 0.5, 1_000).alias(f"median_{i}")
                )
    medians = {} if approximate else exact_medians(df, numeric)
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    entries = []
    for i, field in enumerate(fields):
        is_number, ordered = field.name in numeric, is_ordered(field.dataType)
        if approximate:
            median = F.col(f"median_{i}") if is_number else no_number
            unique = F.col(f"unique_{i}")
        else:
            median = F.lit(medians.get(field.name)).cast("double")
            unique = F.lit(None).cast("bigint")
        entries.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column"),
                F.col("rows").alias("values_count"),
                F.col(f"nulls_{i}").alias("null_count"),
                F.col(f"missing_{i}").alias("missing_count"),
                (F.col(f"min_{i}") if ordered else no_text).alias("min"),
                (F.col(f"max_{i}") if ordered else no_text).alias("max"),
                (F.col(f"mean_{i}") if is_number else no_number).alias("mean"),
                median.alias("median"),
                unique.alias("unique_count"),
            )
        )
    profile = df.agg(*aggregates).select(F.inline(F.array(*entries)))
    if not approximate:
        distinct = F.broadcast(_distinct_counts(df, fields))  # one row per column
        profile = profile.drop("unique_count").join(distinct, "position", "left")
    unique = F.coalesce("unique_count", F.lit(0))
    return profile.select(
        F.lit(table).alias("table"),
        "column",
        stamp(ts).alias("ts"),
        "values_count",
        "null_count",
        "missing_count",
        unique.alias("unique_count"),
        F.try_divide("null_count", "values_count").alias("null_proportion"),
        F.try_divide(unique, "values_count").alias("unique_proportion"),
        "min",
        "max",
        "mean",
        "median",
    )


def is_ordered(kind: T.DataType) -> bool:
    return isinstance(kind, (T.AtomicType,)) and not isinstance(kind, (T.BinaryType, T.BooleanType))


def comparable(column: Column, kind: T.DataType) -> tuple[str, Column]:
    """A column as long, double or text such that equal values stay equal, others differ."""
    if isinstance(kind, T.IntegralType):
        return "whole", column.cast("bigint")
    if isinstance(kind, T.TimestampType):  # its text has no zone and repeats an hour a year
        return "whole", F.unix_micros(column)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "real", column.cast("double")
    if isinstance(kind, T.BinaryType):
        return "text", F.hex(column)
    return "text", column.cast("string")


def _distinct_counts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Exact distinct non-null values per column position.

    Columns are turned into narrow rows (position, value), deduplicated in each task
    before the shuffle, so a frequent value costs one row per task.
    """
    entries = []
    for i, field in enumerate(fields):
        slot, value = comparable(quoted(field.name), field.dataType)
        slots = {"whole": "bigint", "real": "double", "text": "string"}
        entries.append(
            F.when(
                quoted(field.name).isNotNull(),
                F.struct(
                    F.lit(i).alias("position"),
                    *[
                        (value if name == slot else F.lit(None).cast(kind)).alias(name)
                        for name, kind in slots.items()
                    ],
                ),
            )
        )
    return (
        df.select(F.inline(F.array(*entries)))
        .where(F.col("position").isNotNull())
        .distinct()
        .groupBy("position")
        .agg(F.count(F.lit(1)).alias("unique_count"))
    )


def column_sample_values(
    df: DataFrame, n: int, columns: Sequence[str] | None = None
) -> DataFrame:
    """The n smallest distinct values of each column, shown as text.

    Each scan is one wide aggregate. The first deals the rows into buckets in turn and takes
    every column's minimum in each: n distinct minima are n values of the column, so the
    largest of the n smallest is a bound for what is wanted. The last collects the distinct
    values up to the bounds. Rows are dealt out evenly, so few other values lie below a
    bound, whatever the order of the table. Only the bounds reach the driver, one per column.

    Columns whose buckets show fewer than n values either have few, or their smallest are
    very frequent. A sketch of these columns tells: few values are collected whole, others
    take two more scans, see `_frequent_samples`. Columns of other than plain types, and
    binary ones, are compared as text.
    """
    names = list(columns or df.columns)
    sampled = {name: _sampled(df, name) for name in names}
    buckets = max(1_024, 16 * n)
    held = df.select(
        *[_plain_zero(kind, value).alias(f"v{i}") for i, (kind, value) in enumerate(sampled.values())],
    )
    each = [f"v{i}" for i in range(len(names))]
    dealt = held.withColumn("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(buckets)))
    least = dealt.groupBy("bucket").agg(*[F.min(slot).alias(slot) for slot in each])
    bounds = least.agg(*[F.sort_array(F.collect_set(slot)).alias(slot) for slot in each]).select(
        *[F.get(slot, F.lit(n - 1)).cast("string").alias(slot) for slot in each]
    ).first()
    unsure = [slot for slot in each if bounds[slot] is None]
    values = held.agg(*[F.approx_count_distinct(slot).alias(slot) for slot in unsure]).first() if unsure else {}
    wanted, frequent = [], []
    for name, slot in zip(names, each):
        if bounds[slot] is None and values[slot] > FEW_VALUES:
            frequent.append(name)
            continue
        kept = F.col(slot)
        if bounds[slot] is not None:
            kept = F.when(kept <= F.lit(bounds[slot]).cast(sampled[name][0]), kept)
        wanted.append((name, F.slice(F.sort_array(F.collect_set(kept)), 1, n).alias(slot), slot))
    parts = []
    if wanted:
        one = held.agg(*[found for _, found, _ in wanted])
        entries = [
            F.struct(F.lit(name).alias("column"), F.transform(slot, partial(_shown, df, name)).alias("values"))
            for name, _, slot in wanted
        ]
        one = one.select(F.inline(F.array(*entries))).select("column", F.posexplode("values").alias("rank", "value"))
        parts.append(one.select("column", (F.col("rank") + 1).alias("rank"), "value"))
    if frequent:
        parts.append(_frequent_samples(df, n, frequent))
    return reduce(DataFrame.unionByName, parts)


def _plain_zero(kind: T.DataType, value: Column) -> Column:
    """A value with one zero only, as grouping sees it."""
    return value + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else value


def _shown(df: DataFrame, name: str, value: Column) -> Column:
    """A sampled value as text."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        value = F.timestamp_micros(value)
    return value.cast("string")


def _frequent_samples(df: DataFrame, n: int, names: Sequence[str]) -> DataFrame:
    """The n smallest values of columns whose smallest values are very frequent.

    Values are dealt into buckets by their hash, so that equal ones share a bucket, however
    many they are; that takes a row per value in the scan. The n-th smallest of the buckets'
    minima is the bound, the second scan keeps the distinct values up to it.
    """
    buckets = max(1_024, 16 * n)
    slots = [f"v{k}" for k in range(len({_sampled(df, name)[0] for name in names}))]
    numbered = F.row_number().over(Window.partitionBy("position").orderBy(*slots))
    least = (
        _slotted(df, names)
        .groupBy("position", F.pmod(F.xxhash64(*slots), F.lit(buckets)).alias("bucket"))
        .agg(*[F.min(slot).alias(slot) for slot in slots])
    )
    bounds = {
        names[row["position"]]: row["bound"]
        for row in least.withColumn("rank", numbered)
        .where(F.col("rank") == n)
        .select("position", F.coalesce(*[F.col(slot).cast("string") for slot in slots]).alias("bound"))
        .collect()
    }
    shown = [_shown(df, name, F.col(slot)) for name, (_, slot) in _slots(df, names).items()]
    return (
        _slotted(df, names, bounds)
        .distinct()
        .withColumn("rank", numbered)
        .where(F.col("rank") <= n)
        .select(
            F.element_at(F.array(*[F.lit(name) for name in names]), F.col("position") + 1)
            .alias("column"),
            "rank",
            F.element_at(F.array(*shown), F.col("position") + 1).alias("value"),
        )
    )


def _sampled(df: DataFrame, name: str) -> tuple[T.DataType, Column]:
    """A column in an ordered type whose text gives the value back."""
    kind, column = df.schema[name].dataType, quoted(name)
    if isinstance(kind, T.BinaryType):
        return T.StringType(), F.hex(column)
    if isinstance(kind, T.TimestampType):  # its text names some instants twice
        return T.LongType(), F.unix_micros(column)
    if not isinstance(kind, T.AtomicType):
        return T.StringType(), column.cast("string")
    return kind, column


def _slots(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[T.DataType, str]]:
    """Type and slot of each column; columns of one type share a slot."""
    kinds = {name: _sampled(df, name)[0] for name in names}
    order = list(dict.fromkeys(kinds.values()))
    return {name: (kind, f"v{order.index(kind)}") for name, kind in kinds.items()}


def _slotted(
    df: DataFrame, names: Sequence[str], bounds: Mapping[str, str] | None = None
) -> DataFrame:
    """Rows (position, v0, v1, ...) of the non-null values, up to a column's bound if it has one."""
    slots = _slots(df, names)
    kinds = {slot: kind for kind, slot in slots.values()}
    entries = []
    for i, name in enumerate(names):
        kind, value = _sampled(df, name)
        wanted = value.isNotNull()
        if bounds and name in bounds:
            wanted &= value <= F.lit(bounds[name]).cast(kind)
        held = [
            (value if slot == slots[name][1] else F.lit(None)).cast(kinds[slot]).alias(slot)
            for slot in kinds
        ]
        entries.append(F.when(wanted, F.struct(F.lit(i).alias("position"), *held)))
    return df.select(F.inline(F.array(*entries))).where(F.col("position").isNotNull())


def sample_rows(df: DataFrame, n: int, order: Sequence[str] | None = None) -> DataFrame:
    """The first n rows by the given columns, or by all; each task keeps n rows."""
    return df.orderBy(*[quoted(name) for name in (order or df.columns)]).limit(n)


def sample_payload(df: DataFrame, n: int, order: Sequence[str] | None = None) -> DataFrame:
    """One row: the column names and n rows of values as text."""
    row = F.array(*[quoted(name).cast("string") for name in df.columns])
    return sample_rows(df, n, order).select(row.alias("row")).agg(
        F.array(*[F.lit(name) for name in df.columns]).alias("columns"),
        F.sort_array(F.collect_list("row")).alias("rows"),
    )
