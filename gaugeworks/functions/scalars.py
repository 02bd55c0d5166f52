"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_text(column: Column) -> Column:
    """True where a key is usable: neither null nor the empty string."""
    return column.isNotNull() & (column != "")


def floor_bucket(column: Column) -> Column:
    """Integer part towards minus infinity, as int.

    Values beyond the int range become null instead of wrapping or raising.
    floor(NaN) is 0 in Spark, so a NaN lands in bucket 0.
    """
    return F.floor(column).try_cast("int")


def share_of(count: Column, whole: float) -> Column:
    """count / whole as a double; not limited to 1."""
    return count / F.lit(float(whole))


def or_default(column: Column, default: str) -> Column:
    """The column, or a fixed text where it is null."""
    return F.coalesce(column, F.lit(default))


def quoted(name: str) -> Column:
    """Column by its exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def holds_word(lowered: Column, word: str) -> Column:
    """True where a lower-cased text has the word between other characters or its ends."""
    return lowered.rlike(f"(?<![a-z0-9]){word}(?![a-z0-9])")


def is_blank(column: Column, kind: str) -> Column:
    """Missing value test for profiling: null, or empty text in a string column."""
    if kind == "string":
        return column.isNull() | (column == "")
    return column.isNull()


def stamp(ts: datetime | Column | None) -> Column:
    """Time of a profile or check: a column, a fixed time, or null."""
    return ts if isinstance(ts, Column) else F.lit(ts).cast("timestamp")
