"""A table of one row per key, kept in folders by hash bucket of the key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.scalars import quoted
from gaugeworks.operators.latest import upsert_latest
from gaugeworks.session import settle

BUCKET = "key_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Latest row per key at a path; `schema` without the bucket column, which the layout adds.

    A write reads and replaces the buckets that its keys fall into, and leaves all others
    as they are. The number of buckets is fixed for the table's life: take about its size
    over what a task rewrites with ease. One write at a time.
    """

    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    ts: str = "ts"
    seq: str = "seq"
    buckets: int = 1_024

    def read(self, spark: SparkSession, touched: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; empty before the first write."""
        stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        try:
            rows = spark.read.schema(stored).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], stored)
        if touched is not None:
            rows = rows.where(F.col(BUCKET).isin(list(touched)))
        return rows.select(*[quoted(name) for name in self.schema.names])

    def upsert(self, writes: DataFrame) -> list[int]:
        """Apply writes, the last of each key by (ts, seq) wins; returns the buckets rewritten.

        Writes shrink to one row per key first, so a key written often costs a row per task.
        The numbers of the touched buckets, at most `buckets`, come to the driver. Buckets
        are replaced by one job that Spark commits as a whole partition each; repeating the
        same writes changes no row.
        """
        spark = writes.sparkSession
        self._check_buckets(spark)
        rows = writes.select(*[quoted(name) for name in self.schema.names])
        newest = settle(upsert_latest(rows.limit(0), rows, self.keys, self.ts, self.seq))
        touched = sorted(row[0] for row in newest.select(self._bucket().alias(BUCKET)).distinct().collect())
        if not touched:
            return []
        merged = upsert_latest(self.read(spark, touched), newest, self.keys, self.ts, self.seq)
        merged = settle(merged.withColumn(BUCKET, self._bucket()))  # it reads what the write replaces
        (
            merged.repartition(BUCKET).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        )
        return touched

    def _bucket(self):
        return F.pmod(F.xxhash64(*[quoted(key) for key in self.keys]), F.lit(self.buckets)).cast("int")

    def _check_buckets(self, spark: SparkSession) -> None:
        stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        try:
            row = spark.read.schema(stored).parquet(self.path).select(BUCKET, self._bucket().alias("now")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        if row is not None and row[BUCKET] != row["now"]:
            raise ValueError(f"{self.path} was not written with {self.buckets} buckets of {self.keys}")
