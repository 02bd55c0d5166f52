"""Keyed tables: latest value, version history, entity pages, editorial overlay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.scalars import quoted
from gaugeworks.operators.joins import hot_buckets
from gaugeworks.session import settle

TARGET_SLICE_ROWS = 1_000_000


def upsert_latest(
    current: DataFrame,
    writes: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    seq: str = "seq",
) -> DataFrame:
    """Current rows with later writes applied: the last write of each key wins.

    Applying the same writes again changes nothing. (ts, seq) must leave no ties. Tasks
    keep one row per key before the shuffle, so a hot key costs one row per task.
    """
    columns = current.columns
    others = F.struct(*[quoted(c) for c in columns if c not in keys])
    newest = F.max_by(others, F.struct(quoted(ts), quoted(seq))).alias("_newest")
    return (
        current.unionByName(writes).groupBy(*keys).agg(newest)
        .select(*keys, "_newest.*")
        .select(*columns)
    )


def aspect_versions(
    log: DataFrame,
    keys: Sequence[str] = ("urn", "aspect"),
    ts: str = "ts",
    seq: str = "seq",
    *,
    slice_rows: int = TARGET_SLICE_ROWS,
) -> DataFrame:
    """Number each key's rows from newest (version 0) to oldest, keeping them all.

    Ordinary keys are numbered by one window. A hot key is cut along its time into slices
    (see `_slice_hot_keys`); each slice is numbered by a task of its own, then shifted by
    the size of the newer slices. The table is shuffled once.
    """
    keys = list(keys)
    sliced, path = _slice_hot_keys(log, keys, ts, seq, slice_rows)
    groups = keys + path
    newest_first = Window.partitionBy(*groups).orderBy(F.desc(ts), F.desc(seq))
    numbered = sliced.withColumn("version", F.row_number().over(newest_first) - 1)
    if path:
        newer_slices = Window.partitionBy(*keys).orderBy(*[F.desc(p) for p in path])
        ahead = (
            sliced.where(F.col(path[0]).isNotNull())
            .groupBy(*groups)
            .agg(F.count(F.lit(1)).alias("_rows"))
            .withColumn("_ahead", F.sum("_rows").over(newer_slices) - F.col("_rows"))
            .drop("_rows")
        )
        # One row per slice of a hot key: bounded per level of cutting, whatever the table.
        numbered = _left_join_same(numbered, F.broadcast(ahead), groups).withColumn(
            "version", F.col("version") + F.coalesce("_ahead", F.lit(0))
        )
    return numbered.select(*[quoted(c) for c in log.columns], F.col("version").cast("bigint"))


def _slice_hot_keys(
    log: DataFrame, keys: list[str], ts: str, seq: str, slice_rows: int
) -> tuple[DataFrame, list[str]]:
    """Cut keys with too many rows into consecutive slices of their (ts, seq) order.

    Adds one column per level of cutting; null means not cut there. A group is hot if it
    has more than `slice_rows` rows and more than 1/MAX_HOT_BUCKETS of the table, so fewer
    than MAX_HOT_BUCKETS can be hot at a time and their table may be broadcast. Only rows
    in hot hash buckets are looked at per key. A hot group is cut into parts of equal width
    between its first and last time, or sequence where all times are equal; there are at
    most 4 * MAX_HOT_BUCKETS parts besides one per group. Parts still hot, as when times
    bunch up, are cut again at the next level between their own first and last. Cuts are
    written to the shared folder, so that a task that is run again sees the same ones.
    """
    path: list[str] = []
    buckets = hot_buckets(log, keys, slice_rows)
    if not buckets.rows:
        return log, path
    part_rows = max(slice_rows, buckets.limit // 4)
    oldest = F.lit(-(2**62))
    instant = F.coalesce(_micros(ts, log.schema[ts].dataType), oldest)
    number = F.coalesce(F.col(seq).cast("bigint"), oldest)
    sliced, candidates = log, log.where(buckets.holds())
    while True:
        hot = settle(
            candidates.groupBy(*keys, *path)
            .agg(
                F.count(F.lit(1)).alias("_n"),
                F.min(instant).alias("_t0"),
                F.max(instant).alias("_t1"),
                F.min(number).alias("_s0"),
                F.max(number).alias("_s1"),
            )
            .where(F.col("_n") > buckets.limit)
            .where((F.col("_t1") > F.col("_t0")) | (F.col("_s1") > F.col("_s0")))
            .withColumn("_parts", F.ceil(F.col("_n") / part_rows))
            .drop("_n")
        )
        if hot.isEmpty():
            return sliced, path
        part = F.when(
            F.col("_t1") > F.col("_t0"), _part(instant, "_t0", "_t1")
        ).otherwise(_part(number, "_s0", "_s1"))
        level = f"_slice{len(path)}"
        sliced = (
            _left_join_same(sliced, F.broadcast(hot), keys + path)
            .withColumn(level, part)
            .drop("_t0", "_t1", "_s0", "_s1", "_parts")
        )
        path.append(level)
        candidates = sliced.where(F.col(level).isNotNull())


def _micros(ts: str, kind: T.DataType) -> Column:
    """Time as microseconds that grow with it; wall-clock times are not read in a zone."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(ts).cast("timestamp"))
    days = F.unix_date(F.col(ts).cast("date")).cast("bigint")
    minutes = days * 1440 + F.hour(ts) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), F.col(ts)).cast("decimal(8,6)")
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def _part(value: Column, low: str, high: str) -> Column:
    """Number of the part a value falls into: 0 at low, _parts at high, never falling between."""
    first, last = F.col(low).cast("double"), F.col(high).cast("double")
    share = (value.cast("double") - first) / F.nullif(last - first, F.lit(0.0))
    return F.floor(share * F.col("_parts"))


def _left_join_same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equal keys, null being equal to null; each key once in the result."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(renamed[f"_same_{k}"])
    return left.join(renamed, match, "left").drop(*[f"_same_{k}" for k in keys])


def entity_page(
    log: DataFrame, aspects: Sequence[str] | None = None, ts: str = "ts", seq: str = "seq"
) -> DataFrame:
    """One row per entity with its newest value of each aspect.

    Whichever aspects an entity has are in `aspects`, a map from name to value in order of
    names; rows without a name are left out of it. With names given, these become columns
    instead.
    """
    newest = F.max_by("value", F.struct(ts, seq))
    if aspects is not None:
        return log.groupBy("urn").pivot("aspect", list(aspects)).agg(newest)
    entry = F.when(F.col("aspect").isNotNull(), F.struct("aspect", "value"))
    return log.groupBy("urn", "aspect").agg(newest.alias("value")).groupBy("urn").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("aspects")
    )


def editorial_overlay(
    ingested: DataFrame,
    edits: DataFrame,
    key: str,
    fields: Sequence[str],
    ts: str = "ts",
    seq: str = "seq",
) -> DataFrame:
    """Ingested rows with hand edits shown over them, field by field.

    `edits` is a log: the newest non-null edit of a field counts. It is reduced to one
    row per key first; the join then has no hot key as long as `ingested` is keyed.
    """
    newest = edits.groupBy(key).agg(*[
        newest_set(field, ts, seq).alias(f"_{field}") for field in fields
    ])
    shown = ingested.join(newest, key, "left")
    for field in fields:
        shown = shown.withColumn(field, F.coalesce(F.col(f"_{field}"), F.col(field)))
    return shown.select(*ingested.columns)


def newest_set(field: str, ts: str, seq: str) -> Column:
    """Newest value that is not null; max_by skips rows whose order value is null."""
    return F.max_by(field, F.when(F.col(field).isNotNull(), F.struct(ts, seq)))
