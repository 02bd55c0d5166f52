"""Version history that grows by batches without rewriting what is stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.scalars import quoted
from gaugeworks.operators.joins import BROADCAST_ROWS, HOT_ROWS, sized_join
from gaugeworks.operators.latest import TARGET_SLICE_ROWS, aspect_versions
from gaugeworks.session import settle

BATCH = "batch"


@dataclass(frozen=True)
class VersionHistory:
    """Every row of a change log with its rank from the oldest, and a count per key.

    A row's version, 0 for the newest, is its key's count less its rank, so newer rows do
    not change what is stored with older ones. Below the path, `rows` and `counts` have a
    folder per batch: the batch's rows with their ranks, and the new counts of its keys.

    `epoch` tells rankings of a key apart: rows that come late, older than what is stored of
    their key, have that key ranked anew. All its rows are then appended once more under
    the next epoch, and those of earlier epochs no longer count.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...] = ("urn", "aspect")
    ts: str = "ts"
    seq: str = "seq"
    slice_rows: int = TARGET_SLICE_ROWS
    max_rows: int = BROADCAST_ROWS
    hot_rows: int = HOT_ROWS

    def append(self, changes: DataFrame, batch: int) -> int:
        """Add the changes of a batch; returns the number of keys that were ranked anew.

        Batches are numbered upwards. The last one may be repeated, which replaces its own
        folders and changes nothing. Keys must not be null, and (ts, seq) leave no ties
        within a key. Counts are looked up for the batch's keys only.
        """
        spark = changes.sparkSession
        newest = self._read(spark, "counts").agg(F.max(BATCH).alias(BATCH)).first()[BATCH]
        if newest is not None and batch < newest:
            raise ValueError(f"batch {batch} comes after batch {newest}")
        rows = settle(changes.select(*[quoted(name) for name in self.schema.names]))
        touched = rows.groupBy(*self.keys).agg(F.min(self._when()).alias("_from"))
        known = sized_join(
            self._counts(spark, batch), touched.select(*self.keys), self.keys, "left_semi",
            max_rows=self.max_rows, hot_rows=self.hot_rows,
        )
        state = settle(touched.join(known, list(self.keys), "left").withColumn(
            "_late", F.coalesce(F.col("_from") <= F.col("newest"), F.lit(False))
        ).select(
            *self.keys, F.coalesce("n", F.lit(0)).alias("_n"), F.coalesce("epoch", F.lit(0)).alias("epoch"), "_late"
        ))
        late = state.where("_late").select(*self.keys, "epoch")
        n_late = late.count()
        if n_late:
            history = self._ranked(spark, batch).drop(BATCH, "rank")
            old = self._join(history, late, [*self.keys, "epoch"], "left_semi").drop("epoch")
            rows = rows.unionByName(old)
        ranked = aspect_versions(rows, self.keys, self.ts, self.seq, slice_rows=self.slice_rows)
        counts = ranked.groupBy(*self.keys).agg(
            F.count(F.lit(1)).alias("_rows"), F.max(self._when()).alias("newest")
        ).join(state, list(self.keys))
        counts = settle(counts.select(
            *self.keys, "newest", "_rows",
            (F.col("epoch") + F.col("_late").cast("int")).alias("epoch"),
            F.when(F.col("_late"), 0).otherwise(F.col("_n")).alias("_before"),
        ))
        ranked = self._join(ranked, counts.drop("newest"), list(self.keys), "inner")
        ranked = ranked.withColumn("rank", F.col("_before") + F.col("_rows") - F.col("version"))
        self._write(ranked.select(*[quoted(name) for name in self.schema.names], "epoch", "rank"), "rows", batch)
        # Last: a batch without its counts is not seen.
        self._write(counts.select(
            *self.keys, (F.col("_before") + F.col("_rows")).alias("n"), "epoch", "newest"
        ), "counts", batch)
        return n_late

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows with their version."""
        counts = self._counts(spark)
        rows = self._join(self._ranked(spark), counts.drop("newest"), [*self.keys, "epoch"], "inner")
        # A rank beyond the count belongs to a batch whose counts are not there yet.
        return rows.where("rank <= n").select(
            *[quoted(name) for name in self.schema.names], (F.col("n") - F.col("rank")).alias("version")
        )

    def _join(self, left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
        return sized_join(left, right, on, how, max_rows=self.max_rows, hot_rows=self.hot_rows)

    def _when(self) -> Column:
        return F.struct(quoted(self.ts).alias("ts"), quoted(self.seq).alias("seq"))

    def _counts(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Newest count of each key, up to a batch."""
        counts = self._read(spark, "counts")
        if before is not None:
            counts = counts.where(F.col(BATCH) < before)
        latest = F.max_by(F.struct("n", "epoch", "newest"), BATCH).alias("_latest")
        return counts.groupBy(*self.keys).agg(latest).select(*self.keys, "_latest.*")

    def _ranked(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        rows = self._read(spark, "rows")
        return rows if before is None else rows.where(F.col(BATCH) < before)

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/{BATCH}={batch}")

    def _read(self, spark: SparkSession, table: str) -> DataFrame:
        when = T.StructType([self.schema[self.ts], self.schema[self.seq]])
        when = T.StructType([T.StructField(name, f.dataType) for name, f in zip(("ts", "seq"), when)])
        number = [T.StructField(name, T.LongType()) for name in ("rank", BATCH)]
        epoch = T.StructField("epoch", T.IntegerType())
        fields = {
            "rows": [*self.schema.fields, epoch, *number],
            "counts": [
                *[self.schema[key] for key in self.keys], T.StructField("n", T.LongType()), epoch,
                T.StructField("newest", when), number[1],
            ],
        }[table]
        try:
            return spark.read.schema(T.StructType(fields)).parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], T.StructType(fields))
