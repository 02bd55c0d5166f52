"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word as Java's regular expressions write it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where they start beside its folder.

    On a cluster the package comes with --py-files; this adds the folder the driver
    imported it from, which is what local sessions started elsewhere need.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (known, _ROOT) if p)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; bytes.split cuts at exactly the six ASCII white spaces."""
    return encoded(text).split()


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text, null as empty; a lone surrogate becomes a question mark, as in Java."""
    return b"" if text is None else text.encode("utf-8", "replace")


_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, size: int = _PIECE) -> Iterator[bytes]:
    """A text in pieces of about a megabyte, cut at white space, so that a very long one never
    becomes a list of all its words."""
    start = 0
    while start < len(data):
        found = _SPACE.search(data, start + size)
        end = found.end() if found else len(data)
        yield data[start:end]
        start = end


def word_count(text: Column) -> Column:
    """Number of words of a text, null as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a handful of long texts never pile up in Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def partitions_for(spark: SparkSession, n_bytes: int, per_partition: int = 64 << 20) -> int:
    """Shuffle partitions for so many bytes, no fewer than the session asks for."""
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(asked, -(-n_bytes // per_partition))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column; one scan of that column, one number to the driver."""
    return df.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0


def long_id(df: DataFrame, name: str) -> Column:
    """An id column as a long."""
    return F.col(f"`{name}`").cast(T.LongType())


def draw_of(*columns: str) -> Column:
    """Hash of columns as a number in [0, 2**53)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11)


def drawn(share: float, *columns: str) -> Column:
    """True on about that share of the rows: those whose columns hash smallest."""
    return F.lit(True) if share >= 1 else draw_of(*columns) < F.lit(int(share * (1 << 53)))
