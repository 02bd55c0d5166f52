"""Joins that stay balanced whatever the size and skew of their sides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 1_000_000
KEY_BUCKETS = 65_536
MAX_HOT_BUCKETS = KEY_BUCKETS // 2  # a hot bucket holds more than twice the average


@dataclass(frozen=True)
class HotBuckets:
    """Hash buckets of some key columns that hold more than `limit` rows, and their rows."""

    keys: tuple[str, ...]
    limit: int
    rows: dict[int, int]

    def holds(self) -> Column:
        """True on rows whose key falls into a hot bucket."""
        return _bucket(self.keys).isin(list(self.rows))


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure whether a table may be broadcast.

    Rows and bytes are taken by one aggregate where they lie. (A limit would move its number
    of rows from every task into one.)
    """
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df.schema)).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def _row_bytes(schema: T.StructType) -> Column:
    """About the bytes of a row: eight per plain value, texts by their length."""
    size = F.lit(8 * len(schema))
    for field in schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif not isinstance(field.dataType, T.AtomicType):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return size


def hot_buckets(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> HotBuckets:
    """Find where keys with too many rows may be, without a shuffle by key.

    Rows are counted per hash bucket, merged in each task: KEY_BUCKETS counts at most,
    whatever the table's size, and these come to the driver. A bucket is hot above
    `hot_rows` rows and above 1/MAX_HOT_BUCKETS of the table, so fewer than
    MAX_HOT_BUCKETS are. A key with that many rows is in a hot bucket.
    """
    return hot_buckets_of_each(df, [on], hot_rows)[0]


def hot_buckets_of_each(
    df: DataFrame, keys: Sequence[Sequence[str]], hot_rows: int = HOT_ROWS
) -> list[HotBuckets]:
    """`hot_buckets` for several keys of a table, in one scan of it."""
    entries = [
        F.struct(F.lit(i).alias("key"), _bucket(on).alias("bucket")) for i, on in enumerate(keys)
    ]
    counted = (
        df.select(F.inline(F.array(*entries)))
        .groupBy("key", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    found = []
    for i, on in enumerate(keys):
        rows = {row["bucket"]: row["n"] for row in counted if row["key"] == i}
        limit = max(hot_rows, sum(rows.values()) // MAX_HOT_BUCKETS)
        found.append(HotBuckets(tuple(on), limit, {b: n for b, n in rows.items() if n > limit}))
    return found


def sized_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    small: bool | None = None,
    hot: HotBuckets | None = None,
) -> DataFrame:
    """Equi-join of a large left side, possibly with hot keys, to a right side.

    A right side measured as small is broadcast, and the left side is not shuffled. With
    any other, left rows in hot key buckets are spread over salts, and the right rows of
    those buckets, about 1/KEY_BUCKETS of the keys each, are repeated per salt. A left row
    meets exactly one copy, so the result is the plain join's. The salts of all buckets add
    up to less than 2 * MAX_HOT_BUCKETS, so the right side about doubles at worst.

    The right side should have few rows per key; for semi and anti joins it is made
    distinct. `how` is inner, left, left_semi or left_anti; others would see the copies.
    Pass `small` where the right side is measured already, `hot` to reuse the counts of an
    unchanged left side.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if left.isStreaming:
        raise ValueError("join each micro-batch, where keys can be counted")
    for name in on:
        if left.schema[name].dataType != right.schema[name].dataType:
            raise TypeError(f"join column {name} has two types")
    if how in ("left_semi", "left_anti"):
        right = right.select(*on)
    if fits_broadcast(right, max_rows) if small is None else small:
        return left.join(F.broadcast(right), list(on), how)
    if how in ("left_semi", "left_anti"):
        right = right.distinct()
    hot = hot_buckets(left, on, hot_rows) if hot is None else hot
    if not hot.rows:
        return left.join(right, list(on), how)
    needed = [(bucket, -(-rows // hot.limit)) for bucket, rows in hot.rows.items()]
    table = left.sparkSession.createDataFrame(needed, "_bucket int, _salts int")
    left = _with_salts(left, on, table)
    right = _with_salts(right, on, table)
    salts = F.col("_salts")
    left = left.withColumn("_salt", F.pmod(_spread(left), salts).cast("int")).drop("_salts")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def flag_listed(
    df: DataFrame,
    lists: Mapping[str, tuple[str, DataFrame]],
    *,
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add one boolean per list: whether a column's value is in the list (one column: key).

    `lists` maps the name of the boolean to the column and its list, which has each key once.
    Lists too large to broadcast share one count of hot keys, taken from `df` as it came:
    these joins add no rows, so the count holds for all of them.
    """
    small = {flag: fits_broadcast(keys, max_rows) for flag, (_, keys) in lists.items()}
    large = [flag for flag in lists if not small[flag]]
    counted = (
        hot_buckets_of_each(df, [[lists[flag][0]] for flag in large], hot_rows) if large else []
    )
    hot = dict(zip(large, counted))
    for flag, (column, keys) in lists.items():
        listed = keys.select(F.col("key").alias(column), F.lit(True).alias(flag))
        df = sized_join(df, listed, [column], "left", small=small[flag], hot=hot.get(flag))
        df = df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return df


def _bucket(on: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(KEY_BUCKETS)).cast("int")


def _spread(df: DataFrame) -> Column:
    """Number that differs between rows but not between two runs of the same task.

    Floating-point values are left out: a sum that is computed again may differ in its last
    digit. The partition id tells rows apart that are equal in all other columns.
    """
    steady = [
        F.col(f"`{field.name}`")
        for field in df.schema.fields
        if isinstance(field.dataType, T.AtomicType)
        and not isinstance(field.dataType, (T.FloatType, T.DoubleType))
    ]
    return F.xxhash64(*steady) + F.spark_partition_id()


def _with_salts(df: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    return (
        df.withColumn("_bucket", _bucket(on))
        .join(F.broadcast(hot), "_bucket", "left")
        .withColumn("_salts", F.coalesce("_salts", F.lit(1)))
        .drop("_bucket")
    )
